"""Best-fit packing by patterns: non-negative least squares on the length histogram.

Patterns of up to three lengths that fill a sequence exactly are enumerated.
Non-negative least squares fits how often each is repeated to the histogram of
lengths, the counts are rounded to what the histogram has, and the residual is
packed best-fit, largest first, still by counts. All of that works on the
histogram, whose size is bounded by the capacity whatever the corpus has; the
resulting plan says which ranks of which length go where, and every piece finds
its place by its rank among the pieces of its length.

Null text is empty text: a document of the separator alone. Very long texts, and
runs of blanks of any length, are read whole. Repeated rows are further pieces. An
empty table gives no rows. Lengths must be from 1 to the capacity; other lengths, or
null, raise. Other columns are kept; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairloom.llm import bpe
from pairloom.runtime import cut

CAPACITY = 2048
#: Special tokens of byte_bpe_50k.json.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces of one length that are numbered in one group, about, and groups that are summed up together.
GROUP_ROWS, GROUPS = 400, 1000
ITERATIONS = 200

_LOADED: dict[tuple, object] = {}


def _coder(path: str, pattern: str | None, special: dict[str, int]) -> object:
    key = (path, pattern, *special.items())
    if key not in _LOADED:
        if path.endswith(".json"):
            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = not special
        else:
            lines = (x.split() for x in Path(path).read_bytes().splitlines() if x.strip())
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            coder = tiktoken.Encoding(Path(path).name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        _LOADED[key] = coder
    return _LOADED[key]


def _ranked(coder: tiktoken.Encoding, text: str, path: str, pattern: str, special: dict[str, int]) -> np.ndarray:
    """Ids of ``text`` by ranks; a text that the coder's pattern matcher can't take, as with a million blanks in a row, is split by ``bpe``."""
    try:
        return coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:
        parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
        coded = bpe.vocabulary(path, pattern).encode([x for x in parts if x not in special])
        plain = iter(np.frombuffer(x, "<u4") for x in coded)
        return np.concatenate([np.array([special[x]], "<u4") if x in special else next(plain) for x in parts])


def token_ids(text: Column, path: str, pattern: str | None = None, end: int = 0, special: dict[str, int] | None = None) -> Column:
    """Ids of ``text`` and then ``end``, as binary, little-endian unsigned 32-bit.

    ``path`` is a ``.json`` file of the tokenizers library, or the same vocabulary
    as ``.tiktoken`` ranks with the pattern of its pre-tokens, which gives the same
    ids several times faster. Strings of special tokens are ordinary text, unless
    ``special`` names the file's special tokens with their ids: those are matched
    inside texts, as the tokenizers library does by default.
    """

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, pattern, special or {})
        for batch in batches:
            if path.endswith(".json"):
                coded = [x.ids for x in coder.encode_batch_fast(batch.tolist(), add_special_tokens=False)]
            else:
                coded = [_ranked(coder, x, path, pattern, special or {}) for x in batch]
            yield pd.Series([np.append(x, end).astype("<u4").tobytes() for x in coded])

    return ids(F.coalesce(text, F.lit("")))


def pieces(docs: DataFrame, ids: str = "ids", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``piece``, ``start``, ``length`` and the piece's ids.

    Documents over the capacity are cut; the first piece takes the remainder.
    """
    n = (F.octet_length(ids) / 4).cast("int")
    first = F.when(n <= capacity, n).otherwise(F.coalesce(F.nullif(n % capacity, F.lit(0)), F.lit(capacity)))
    rows = docs.withColumn("n", n).withColumn("first", first)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil((F.col("n") - F.col("first")) / capacity).cast("int"))))
    rows = rows.withColumn("start", F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long"))
    rows = rows.withColumn("length", F.when(F.col("piece") == 0, F.col("first")).otherwise(capacity).cast("long"))
    cut_ids = F.substring(F.col(ids), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return rows.withColumn(ids, cut_ids).drop("n", "first")


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths, of those given, that sum to the capacity; 0 fills up."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    small = lengths[lengths <= capacity // 2]
    two = small[there[capacity - small]]
    found.append(np.stack([two, capacity - two, np.zeros_like(two)], 1))
    for a in lengths[lengths <= capacity // 3].tolist():
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        b = b[there[capacity - a - b]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is nearest the histogram.

    Accelerated projected gradient; a length's squared error is divided by its count.
    """
    weight = np.where(histogram > 0, 1 / np.maximum(histogram, 1), 0.0)
    weight[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, j], weights=x, minlength=len(histogram)) for j in range(patterns.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[patterns[:, j]] for j in range(patterns.shape[1]))

    v = np.ones(len(patterns))
    size = 1.0
    for _ in range(15):
        v = back(used(v))
        size = np.linalg.norm(v)
        if not size:
            return np.zeros(len(patterns))
        v /= size
    step = 1 / (1.05 * size)
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(iterations):
        new = np.maximum(y - step * back(used(y) - histogram), 0.0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan_runs(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """Runs: the lengths of a sequence in their order, and how many such sequences."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).tolist()
    runs: list[tuple[list[int], int]] = []
    patterns = exact_patterns(np.flatnonzero(histogram), capacity)
    if len(patterns):
        x = fit_counts(patterns, histogram.astype(np.float64))
        likely = np.flatnonzero(x >= 0.5)
        for p in likely[np.argsort(-x[likely], kind="stable")].tolist():
            lengths = [n for n in patterns[p].tolist() if n]
            k = min(round(x[p]), *(left[n] // lengths.count(n) for n in lengths))
            if k > 0:
                for n in lengths:
                    left[n] -= k
                runs.append((lengths, k))
    active = [n for n in range(1, capacity + 1) if left[n] > 0]
    while active:  # residual: best fit, largest first
        space, chosen, at = capacity, {}, len(active) - 1
        while at >= 0:
            n = active[at]
            times = min(left[n], space // n)
            chosen[n] = times
            space -= n * times
            at = bisect_right(active, space, 0, at) - 1
        k = min(left[n] // times for n, times in chosen.items())
        for n, times in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del active[bisect_right(active, n) - 1]
        runs.append(([n for n, times in chosen.items() for _ in range(times)], k))
    return runs


def plan_table(runs: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each range of ranks of a length, its first sequence and its offset."""
    used = [0] * (capacity + 1)
    keys, froms, bases, offsets = [], [], [], []
    base = 0
    for lengths, k in runs:
        at = 0
        for n in lengths:
            keys.append((n << 44) | used[n])
            froms.append(used[n])
            bases.append(base)
            offsets.append(at)
            used[n] += k
            at += n
        base += k
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    made = {"key": keys, "from": froms, "base": bases, "offset": offsets}
    return {k: np.array(v, np.int64)[order] for k, v in made.items()}


def numbered(rows: DataFrame, histogram: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 within each length.

    Rows of a length are dealt by a hash to groups of a bounded size, which are
    numbered one by one, so a length that a third of all rows have is many groups.
    What comes before a group is summed in two steps, first within runs of groups.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.col("count") / GROUP_ROWS))
    many = histogram.select("length", groups.alias("groups"))  # a row for each length at most
    dealt = rows.join(F.broadcast(many), "length").withColumn("group", F.pmod(F.xxhash64(*order), F.col("groups")))
    sizes = dealt.groupBy("length", "group").count()
    sizes = sizes.withColumn("run", F.floor(F.col("group") / GROUPS))
    earlier = lambda key, order: F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("length", "run").agg(F.sum("count").alias("count")).select("length", "run", earlier(["length"], "run").alias("base"))
    begins = sizes.withColumn("before", earlier(["length", "run"], "group")).join(runs, ["length", "run"]).select("length", "group", (F.col("before") + F.col("base")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(begins, ["length", "group"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "group", "groups")


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``, by their column ``length``.

    ``order`` names columns that tell rows apart; rows equal in all of them may
    change places. ``rows`` is read several times and should be cut.
    """
    rows = rows.drop("sequence_id", "offset")
    histogram = cut(rows.groupBy("length").count())
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram.collect():  # a row for each length at most
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"length {r['length']} is not from 1 to {capacity}")
        counts[r["length"]] = r["count"]
    plan = plan_table(plan_runs(counts), capacity)
    sent = rows.sparkSession.sparkContext.broadcast(plan)
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan = sent.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(plan["key"], (n << 44) | r, side="right") - 1
        return pd.DataFrame({"sequence_id": plan["base"][at] + r - plan["from"][at], "offset": plan["offset"][at]})

    ranked = numbered(rows, histogram, order).withColumn("place", placed("length", "rank"))
    return ranked.withColumns({"sequence_id": F.col("place.sequence_id"), "offset": F.col("place.offset")}).drop("place", "rank")


def packed_documents(docs: DataFrame, key: str, text: str, path: str, pattern: str | None = None, capacity: int = CAPACITY, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of ``docs``: key, piece, start, length, ids_crc32, sequence_id, offset."""
    coded = docs.select(F.col(f"`{key}`").alias(key), token_ids(F.col(f"`{text}`"), path, pattern, special=special).alias("ids"))
    cut_up = pieces(coded, "ids", capacity)
    digest = cut(cut_up.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(digest, [key, "piece", "ids_crc32"], capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
