"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to blocks, queries to blocks of queries; each pair of blocks
is a task. A block is taken in stretches. A stretch keeps a list per dimension,
sorted by component. The lists are read in step for all queries of the task at
once, each query using a list from the end that scores best for it. What was read
gives each candidate a lower and an upper score bound: a component not yet read is
at least the list's far end and at most what stands at the depth reached. A query
stops when no outsider can qualify: no more than ``2 k`` candidates have an upper
bound that reaches its floor, the k-th best lower bound or score so far. The final
scores of those few are then resolved in whole numbers. A query's floor found in
one stretch serves in the next; stretches begin small, so that there soon is one.
The best of each block meet at the end.

Components are whole numbers. Vectors that are null, or hold null or non-finite
components, take no part. Shorter vectors count as filled up with zeros. A row
whose id is null is no candidate and no query. A repeated row is a candidate each
time; of several rows with a query's id the least vector asks, and none of them
is its candidate. Columns other than ``id`` and ``ints`` are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.streams import groups, tasks
from pairloom.runtime import cut

#: Candidates and queries of a task, and candidates of a stretch: of the first and of the longest.
BLOCK, QUERY_BLOCK, FIRST, STRETCH = 8192, 2048, 256, 2048
#: Depths at which bounds are looked at, evenly spaced.
DEPTHS = 12
#: Pairs whose scores are resolved at a time.
PAIRS = 1 << 16
EPS = float(np.finfo(np.float32).eps)


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null where a vector takes no part."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(doubles, lambda x: F.floor(F.lit(scale) * x).cast("long")))


class Lists:
    """Sorted lists of one stretch of candidates, read from both ends in step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0).astype(np.float32)
        self.cells = order * width + np.arange(width)
        depths = np.linspace(0, n, DEPTHS + 1).astype(np.int64)
        self.depths = np.unique(depths[depths > 0])
        # what was read from the high end, then from the low end
        self.read, self.seen = np.zeros((2, n * width), np.float32), np.zeros((2, n * width), bool)
        self.done = 0

    def read_to(self, depth: int) -> None:
        n, a, b = len(self.ids), self.done, depth
        for end, rows in enumerate((slice(n - b, n - a), slice(a, b))):
            cells = self.cells[rows].ravel()
            self.read[end, cells] = self.values[rows].ravel()
            self.seen[end, cells] = True
        self.done = depth

    def bound(self, weights: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Scores by candidate and query if the unread components were ``high`` and ``low``."""
        n, width = self.vectors.shape
        sides = [np.where(self.seen[e].reshape(n, width), self.read[e].reshape(n, width), x) for e, x in enumerate((high, low))]
        return np.hstack(sides) @ weights

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of rows and queries that may be among the k best, and how many entries the queries read.

        Of a query's candidates all that are left out score less than ``floor`` or
        than k others; ``floor`` is raised in place.
        """
        n, width = self.vectors.shape
        weight = queries.T.astype(np.float32)
        weights = np.vstack((np.maximum(weight, 0), np.minimum(weight, 0)))
        least, most = self.values[0], self.values[-1]
        # rounding of the products above
        slack = EPS * (2 * width + 4) * (np.abs(weight) * np.maximum(np.abs(least), np.abs(most))[:, None]).sum(0)
        rows, asks = [], []
        left = np.arange(len(own))
        entries = 0
        for depth in self.depths.tolist():
            high, low = self.values[n - depth], self.values[depth - 1]
            # no reading can end before a candidate not read at all falls below the floor
            unread = np.concatenate((high, low)) @ weights[:, left]
            if depth < n and not (unread + slack[left] < floor[left]).any() and np.isfinite(floor[left]).all():
                continue
            self.read_to(depth)
            lower = self.bound(weights[:, left], least, most) - slack[left]
            upper = self.bound(weights[:, left], high, low) + slack[left]
            other = self.ids[:, None] != own[left]
            lower[~other] = -np.inf
            if n > k:
                few = np.flatnonzero((lower > floor[left]).sum(0) >= k)
                if len(few):
                    floor[left[few]] = np.maximum(floor[left[few]], np.partition(lower[:, few], n - k, axis=0)[n - k])
            may = other & (upper >= floor[left])
            ended = (may.sum(0) <= 2 * k) if depth < n else np.ones(len(left), bool)
            row, at = np.nonzero(may[:, ended])
            rows.append(row)
            asks.append(left[ended][at])
            entries += int(ended.sum()) * depth * width
            left = left[~ended]
            if not len(left):
                break
        return np.concatenate(rows), np.concatenate(asks), entries


def _stretches(n: int) -> Iterator[tuple[int, int]]:
    at, size = 0, FIRST
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(2 * size, STRETCH)


def search(candidates: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(query, candidate, score)`` of the k best of a block for each query, and entries read."""
    ids, vectors = candidates
    own, asked = queries
    at, found_ids, found = (np.zeros(0, np.int64) for _ in range(3))
    floor = np.full(len(own), -np.inf)
    entries = 0
    for a, b in _stretches(len(ids)) if len(own) else ():
        lists = Lists(ids[a:b], vectors[a:b])
        rows, asks, read = lists.best(own, asked, k, floor)
        entries += read
        parts = [np.einsum("ij,ij->i", lists.vectors[rows[p : p + PAIRS]], asked[asks[p : p + PAIRS]]) for p in range(0, len(rows), PAIRS)]
        at, found_ids, found = np.concatenate((at, asks)), np.concatenate((found_ids, lists.ids[rows])), np.concatenate((found, *parts))
        order = np.lexsort((found_ids, -found, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        at, found_ids, found = at[kept], found_ids[order[kept]], found[order[kept]]
        full = np.flatnonzero(place[kept] == k - 1)
        floor[at[full]] = np.maximum(floor[at[full]], found[full])
    return own[at], found_ids, found, entries


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _each(number: int) -> Column:
    """A row for each block."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``; both tables have ``id`` and ``ints``.

    Scores fit 63 bits. Ties go to the smaller id.
    """
    rows = cut(candidates.where("id IS NOT NULL AND ints IS NOT NULL").select("id", "ints"))
    asks = cut(queries.where("id IS NOT NULL AND ints IS NOT NULL").groupBy("id").agg(F.min("ints").alias("ints")))
    blocks, asked = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK), (asks, QUERY_BLOCK)))
    own, other = F.pmod(F.xxhash64("id", "ints"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(asked))
    # every block of candidates meets every block of queries
    c = rows.select(own.alias("block"), _each(asked).alias("asked"), F.lit(0).alias("side"), "id", "ints")
    q = asks.select(_each(blocks).alias("block"), other.alias("asked"), F.lit(1).alias("side"), "id", "ints")
    both = c.unionByName(q)
    both = both.repartition(max(tasks(both), blocks * asked), "block", "asked").sortWithinPartitions("block", "asked", "side", "id")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in groups(batches, ["block", "asked"]):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = frame.iloc[a:b]
                width = max(1, int(part["ints"].map(len).max()))
                vectors, ids, side = _matrix(part["ints"], width), part["id"].to_numpy(np.int64), part["side"].to_numpy()
                query_id, vec_id, score, _ = search((ids[side == 0], vectors[side == 0]), (ids[side == 1], vectors[side == 1]), k)
                yield pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    near = both.mapInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
