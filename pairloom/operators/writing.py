"""How texts are written: profiles from word counts, paraphrase marks, drift between versions.

Word counts are grouped over all documents, so a long text is spread over tasks
until its counts are small. A blank or null text has zeros everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pairloom.functions.markup import spoken_sentences, stripped
from pairloom.functions.text import WORD, count_words, let, text_of, words

# Tools with their word entropy and passive share.
TOOLS = {"quillbot": (0.65, 0.82), "spinbot": (0.85, 0.45), "wordtune": (0.50, 0.70)}
# Forms of "to be" that may begin a passive.
TO_BE = ("is", "was", "were", "are", "been", "being")
# Weights of the parts of a profile in a deviation.
WEIGHTS = {"type_token_ratio": 1.5, "avg_sentence_length": 1.0, "sentence_length_variance": 2.0, "avg_word_length": 0.5, "punctuation_frequency": 1.0, "yules_k": 1.5}
PUNCTUATION = r"[.!?;:,'\"()\[\]{}\-]"


def word_totals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, v, squares, bits, letters`` of documents with words."""
    each = docs.select(key, F.explode(words(text)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    c = F.col("c")
    return each.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(c * c).alias("squares"), F.sum(c * F.log2(c)).alias("bits"), F.sum(c * F.length("w")).alias("letters"))


def _moments(lengths: Column) -> Column:
    """Struct of number, sum and sum of squares."""
    zero = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    return F.aggregate(lengths, zero, lambda a, x: F.struct((a["k"] + 1).alias("k"), (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")))


def _variance(m: Column) -> Column:
    """Sample variance of lengths by their moments; 0 for fewer than two."""
    return F.when(m["k"] > 1, (m["q"] - m["s"].cast("double") * m["s"] / m["k"]) / (m["k"] - 1)).otherwise(0.0)


def _piece_words(sentence: Column) -> Column:
    return F.size(F.filter(F.split(sentence, r"\s+"), lambda w: w != ""))


def paraphrase_prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Word entropy, variance of sentence lengths, passive share, and the tool whose signature is nearest."""
    passive = let(words(text), lambda w: F.when(F.size(w) >= 3, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.element_at(w, i).isin(*TO_BE) & F.endswith(F.element_at(w, i + 1), F.lit("ed")))) * 100.0 / F.size(w)).otherwise(0.0))
    own = docs.select(key, _moments(F.transform(spoken_sentences(text), _piece_words)).alias("m"), F.round(F.least(F.lit(1.0), passive), 4).alias("transition_anomaly"))
    met = own.join(word_totals(docs, key, text), key, "left")
    entropy = F.when(F.col("v") > 1, (F.log2("n") - F.col("bits") / F.col("n")) / F.log2("v")).otherwise(0.0)
    made = met.select(key, F.round(entropy, 4).alias("synonym_entropy"), F.round(_variance(F.col("m")), 4).alias("sentence_length_variance"), "transition_anomaly")
    near = [F.struct((-1 / (1 + F.sqrt((F.col("synonym_entropy") - e) ** 2 + (F.col("transition_anomaly") - p) ** 2))).alias("s"), F.lit(t).alias("tool")) for t, (e, p) in TOOLS.items()]
    return made.withColumn("best", F.array_min(F.array(*near))).select(*made.columns, F.col("best.tool").alias("tool"), F.round(-F.col("best.s") * 100, 2).alias("confidence"))


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Type-token ratio, sentence lengths and their variance, word length, punctuation per 100 words, Yule's K."""
    lengths = F.transform(F.filter(spoken_sentences(text), lambda s: s != ""), lambda s: F.regexp_count(s, F.lit(WORD)))
    own = docs.select(key, _moments(lengths).alias("m"), F.regexp_count(text_of(text), F.lit(PUNCTUATION)).alias("marks"))
    met = own.join(word_totals(docs, key, text), key, "left")
    n = F.col("n").cast("double")

    def some(c: Column) -> Column:
        return F.when(F.col("n") > 0, c).otherwise(0.0)

    return met.select(
        key,
        F.round(some(F.col("v") / n), 6).alias("type_token_ratio"),
        F.round(F.when(F.col("m.k") > 0, F.col("m.s") / F.col("m.k")).otherwise(0.0), 6).alias("avg_sentence_length"),
        F.round(_variance(F.col("m")), 6).alias("sentence_length_variance"),
        F.round(some(F.col("letters") / n), 6).alias("avg_word_length"),
        F.round(some(F.col("marks") / n * 100), 6).alias("punctuation_frequency"),
        F.round(some(F.greatest(F.lit(0.0), (F.col("squares") / (n * n) - 1 / n) * 10000)), 6).alias("yules_k"),
    )


def deviations(made: DataFrame, key: str, author: str) -> DataFrame:
    """Weighted distance of each profile from the mean profile of its author."""
    base = made.groupBy(author).agg(*[F.avg(c).alias(f"base_{c}") for c in WEIGHTS])
    total = sum((w * (F.col(c) - F.col(f"base_{c}")) ** 2 for c, w in WEIGHTS.items()), F.lit(0.0))
    return made.join(base, author).select(key, author, F.round(F.sqrt(total), 3).alias("deviation"))


def drift(a: str, b: str) -> dict[str, Column]:
    """Change from one version of a text to another: words, sentences, and how much stays."""
    shared = let(F.struct(F.array_distinct(words(a)).alias("x"), F.array_distinct(words(b)).alias("y")), lambda w: F.struct(F.size(F.array_intersect(w["x"], w["y"])).alias("s"), F.size(F.array_union(w["x"], w["y"])).alias("u")))
    lexical = F.when(shared["u"] > 0, 1 - shared["s"] / shared["u"]).otherwise(0.0)
    one = F.struct(*[_moments(F.transform(spoken_sentences(t), _piece_words)).alias(n) for t, n in ((a, "x"), (b, "y"))])

    def structural(m: Column) -> Column:
        ka, kb = m["x"]["k"], m["y"]["k"]
        la, lb = m["x"]["s"] / ka, m["y"]["s"] / kb
        return (F.abs(ka - kb) / F.greatest(ka, kb) + F.abs(la - lb) / F.greatest(la, lb, F.lit(1.0))) / 2

    return {"lexical_drift": lexical, "structural_variance": let(one, structural)}


def two_text_tf_idf(pairs: DataFrame, docs: DataFrame, key: str, text: str, rarity: float = 2.0) -> DataFrame:
    """Cosine of each pair ``doc_a, doc_b`` with the weights of a corpus of these two texts.

    A word of both texts weighs 1, a word of one ln ``rarity`` + 1, so sums of squared
    counts, once over all words and once over shared ones, are enough.
    """
    counts = docs.select(F.col(key).alias("id"), F.explode(words(text)).alias("w")).groupBy("id", "w").agg(F.count("*").alias("c"))
    squares = counts.groupBy("id").agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    a = counts.select(F.col("id").alias("doc_a"), "w", F.col("c").alias("ca"))
    b = counts.select(F.col("id").alias("doc_b"), "w", F.col("c").alias("cb"))
    ca, cb = F.col("ca"), F.col("cb")
    shared = pairs.join(a, "doc_a").join(b, ["doc_b", "w"]).groupBy("doc_a", "doc_b").agg(F.sum(ca * cb).alias("dot"), F.sum(ca * ca).alias("sa"), F.sum(cb * cb).alias("sb"))
    alone = (F.ln(F.lit(float(rarity))) + 1) ** 2
    met = pairs.join(shared, ["doc_a", "doc_b"], "left").join(squares.select(F.col("id").alias("doc_a"), F.col("q").alias("qa")), "doc_a", "left").join(squares.select(F.col("id").alias("doc_b"), F.col("q").alias("qb")), "doc_b", "left")
    length = lambda q, s: F.sqrt(F.col(s) + (F.col(q) - F.col(s)) * alone)
    return met.select("doc_a", "doc_b", F.least(F.lit(1.0), F.coalesce(F.col("dot") / (length("qa", "sa") * length("qb", "sb")), F.lit(0.0))).alias("sim"))


#: Words that are counted at once, about.
TAKEN = 1 << 20


def word_hashes(words: str | Column) -> Column:
    """64-bit hashes of the words of an array, repeats included; null counts as empty."""
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.expr("cast(array() as array<bigint>)"))


def _row_counts(n: list[np.ndarray], h: list[np.ndarray]) -> np.ndarray:
    """For each row of two lists of words: the sums of products and of squared counts of shared words, then of all squared counts."""
    size = len(n[0])
    word, side = np.concatenate(h), np.repeat([0, 1], [len(h[0]), len(h[1])])
    row = np.concatenate([np.repeat(np.arange(size), x) for x in n])
    by = np.lexsort((word, row))
    word, side, row = word[by], side[by], row[by]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))[: len(word)])
    both = np.diff(np.append(first, len(word)))
    b = np.add.reduceat(side, first) if len(first) else first
    a, at = both - b, row[first]
    sums = (a * b, a * a * (b > 0), b * b * (a > 0), a * a, b * b)
    return np.stack([np.bincount(at, x, size).astype(np.int64) for x in sums], axis=1)


@F.arrow_udf(ArrayType(LongType()))
def _shared_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    ends = np.cumsum(np.asarray(a.value_lengths()) + np.asarray(b.value_lengths()))
    cuts = np.flatnonzero(np.diff(ends // TAKEN, prepend=-1))
    made = [np.zeros((0, 5), np.int64)]
    for at, end in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
        some = [x.slice(at, end - at) for x in (a, b)]
        made.append(_row_counts([np.asarray(x.value_lengths()) for x in some], [x.flatten().to_numpy(zero_copy_only=False) for x in some]))
    rows = np.concatenate(made)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, 5, dtype=np.int32)), pa.array(rows.ravel()))


def row_tf_idf(a: Column, b: Column, rarity: float = 2.0) -> Column:
    """``two_text_tf_idf`` of two arrays of ``word_hashes`` of one row, counted within the row: nothing is shuffled."""
    alone = (F.ln(F.lit(float(rarity))) + 1) ** 2

    def cosine(x: Column) -> Column:
        length = lambda q, s: F.sqrt(x[s] + (x[q] - x[s]) * alone)
        return F.when(x[0] > 0, F.least(F.lit(1.0), x[0] / (length(3, 1) * length(4, 2)))).otherwise(0.0)

    return let(_shared_counts(a, b), cosine)


def shared_segments(a: str, b: str) -> Column:
    """Distinct pieces of ``a`` between full stops and line ends that occur in ``b``, letter case aside."""
    pieces = F.array_distinct(F.filter(F.transform(F.split(text_of(a), r"[\n.]"), stripped), lambda s: s != ""))
    return let(F.lower(text_of(b)), lambda low: F.filter(pieces, lambda s: F.contains(low, F.lower(s))))


def paragraphs(text: str, least: int = 5) -> Column:
    """Trimmed paragraphs, split at blank lines, of ``least`` words or more."""
    return F.filter(F.transform(F.split(text_of(text), r"\n\s*\n"), stripped), lambda p: (p != "") & (_piece_words(p) >= least))


def paragraph_matches(a: str, b: str, least: int = 5) -> Column:
    """Array of ``at, best, score``: for each paragraph of ``a`` the most alike of ``b`` by word Jaccard; ties to the earlier."""
    sets = lambda t: F.transform(paragraphs(t, least), lambda p: F.array_distinct(words(p)))

    def of(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            scored = F.transform(s["y"], lambda y, j: F.struct((F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))).alias("score"), (-j).alias("j")))
            return let(F.array_max(scored), lambda m: F.struct(i.alias("at"), (-m["j"]).alias("best"), F.coalesce(m["score"], F.lit(0.0)).alias("score")))

        return F.transform(s["x"], one)

    return let(F.struct(sets(a).alias("x"), sets(b).alias("y")), of)


def rubric(values: DataFrame, key: str, metrics: Sequence[str], rules: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Points of each row: a rule ``(metric, least, points)`` gives its points where the metric reaches ``least``."""
    points = sum((F.when(F.col(m) >= least, p).otherwise(0) for m, least, p in rules if m in metrics), F.lit(0))
    most = sum(p for m, _, p in rules if m in metrics)
    return values.select(key, points.cast("long").alias("points"), F.round(points * 100.0 / max(1, most), 2).alias("percent"))
