"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family picks the family; within
it, one-versus-one machines vote. Features are the square roots of counts of
hashed byte trigrams of the lower-cased text, scaled to unit length. All label
values take part. Machines are fitted on a bounded sample of labelled rows, one
Spark group per machine; the weights (4096 numbers a machine) travel to the tasks
that predict.

A null text, or one without a letter, is ``und`` with score 0. Every text is read
whole, in slices, whatever its length. Without labelled rows all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.runtime import cut

UNDETERMINED = "und"
BUCKETS = 4096
#: Labelled documents of each language that machines are fitted on, about.
TRAIN_ROWS = 600
#: Rows of either side of a machine, about; its languages share them alike.
SIDE_ROWS = 6000
SLICE = 1 << 20

# Families of language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    """A language of no listed family is a family of its own."""
    return FAMILY_OF.get(lang.lower(), f"only:{lang}")


def lettered(text: Column) -> Column:
    """Whether a text has a letter; null of a null text."""
    return F.regexp_like(text, F.lit(r"\p{L}"))


def counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data) - 2), SLICE):
        b = data[at : at + SLICE + 2].astype(np.uint32)
        if len(b) < 3:
            break
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return total


def features(text: str) -> np.ndarray:
    root = np.sqrt(counts(text))
    norm = np.linalg.norm(root)
    return root / norm if norm else root


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM, by dual coordinate descent on the hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, alpha, norms = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(7)
    # the rarer class weighs as much as the other
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ weights) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


def machine_names(languages: list[str]) -> dict[str, tuple[list[str], list[str]]]:
    """Machines with the languages on their positive and their negative side."""
    families: dict[str, list[str]] = {}
    for lang in sorted(languages):
        families.setdefault(family_of(lang), []).append(lang)
    named = {}
    if len(families) > 1:
        for family, own in families.items():
            named[f"family\t{family}"] = (own, [x for x in languages if x not in own])
    for own in families.values():
        for a, b in combinations(own, 2):
            named[f"pair\t{a}\t{b}"] = ([a], [b])
    return named


def fit(labelled: DataFrame, text: str, lang: str, key: str, rows: int = TRAIN_ROWS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and the weights of all machines.

    ``labelled`` is the whole table of labelled rows: each language gives about
    ``rows`` of them, chosen by a hash of ``key`` and text, so no text is shuffled
    to choose. A machine with more than ``SIDE_ROWS`` of them on a side takes a
    share of each language's, so the rows of a machine don't grow with the languages.
    """
    known = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key")).where(F.col("lang").isNotNull())
    known = known.where(lettered(F.col("text")))
    most = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(most)
    named = machine_names(languages)
    if not named:
        return languages, {}
    spark = known.sparkSession
    taken = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_003)) / 1_000_003 < F.col("share")
    shares = spark.createDataFrame([(code, min(1.0, rows / n)) for code, n in most.items()], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").where(taken).select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "counts": [counts(t).astype("<i4").tobytes() for t in batch["text"]]})

    coded = cut(sample.mapInPandas(vectors, "lang string, counts binary"))

    def part(side: list[str]) -> float:
        return min(1.0, SIDE_ROWS / sum(min(rows, most[code]) for code in side))

    whole, single = [], []
    for name, (plus, minus) in named.items():
        if name.startswith("family"):
            whole.append((name, plus, part(plus), part(minus)))
        else:
            single.extend([(plus[0], name, 1, part(plus)), (minus[0], name, -1, part(minus))])
    fields = ["lang", "counts", "machine", "side", "part"]
    roles = coded.join(F.broadcast(spark.createDataFrame(single, "lang string, machine string, side int, part double")), "lang").select(*fields)
    if whole:  # every row has a side in each family's machine
        families = F.broadcast(spark.createDataFrame(whole, "machine string, own array<string>, plus double, minus double"))
        own = F.array_contains("own", F.col("lang"))
        sided = coded.crossJoin(families).withColumns({"side": F.when(own, 1).otherwise(-1), "part": F.when(own, F.col("plus")).otherwise(F.col("minus"))})
        roles = roles.unionByName(sided.select(*fields))
    roles = roles.where(F.pmod(F.xxhash64("counts", "machine"), F.lit(1_000_003)) / 1_000_003 < F.col("part"))

    def train(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "counts"])
        x = np.sqrt(np.stack([np.frombuffer(c, "<i4") for c in group["counts"]]).astype(np.float64))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"machine": [key[0]], "weights": [fit_machine(x, group["side"].to_numpy(np.float64))]})

    fitted = roles.groupBy("machine").applyInPandas(train, "machine string, weights array<double>")
    return languages, {r["machine"]: np.array(r["weights"]) for r in fitted.collect()}


def predict(text: Column, languages: list[str], machines: dict[str, np.ndarray]) -> Column:
    """Struct of the language and a score from 0 to 1, of texts that have a letter."""
    families: dict[str, list[str]] = {}
    for code in sorted(languages):
        families.setdefault(family_of(code), []).append(code)
    names = list(machines)
    matrix = np.array([machines[n] for n in names]) if names else np.zeros((0, BUCKETS + 1))
    place = {n: i for i, n in enumerate(names)}
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def sure(margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))

    def one(body: str | None) -> tuple[str, float]:
        if not languages or body is None:
            return UNDETERMINED, 0.0
        margin = matrix[:, :-1] @ features(body) + matrix[:, -1]
        family, score = next(iter(families)), 1.0
        if len(families) > 1:
            by = {f: margin[place[f"family\t{f}"]] for f in families}
            family = max(by, key=lambda f: by[f])
            score = sure(by[family])
        own = families[family]
        votes, won = dict.fromkeys(own, 0.0), dict.fromkeys(own, 0.0)
        for a, b in combinations(own, 2):
            m = margin[place[f"pair\t{a}\t{b}"]]
            votes[a if m >= 0 else b] += 1
            won[a] += m
            won[b] -= m
        lang = max(own, key=lambda x: (votes[x], won[x]))
        for other in own:
            if other != lang:
                a, b = sorted((lang, other))
                m = margin[place[f"pair\t{a}\t{b}"]]
                score = min(score, sure(m if a == lang else -m))
        return lang, score

    @F.pandas_udf(schema)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=["lang", "score"])

    return guess(text)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from training; a null key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; machines are fitted on ``train``."""
    languages, machines = fit(train, text, lang, key)
    body = F.col(f"`{text}`")
    judged = docs.withColumn("lang_pred", predict(F.when(lettered(body), body), languages, machines))
    return judged.withColumn("score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))
