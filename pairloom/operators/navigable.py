"""A navigable graph of near vectors: built by joining neighbours of neighbours, searched by a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import cut

#: Rows of a first random group, over twice the neighbours; parts that a long list is ranked in first.
GROUPS, PARTS = 2, 32
#: Rows of a shard, about; rows whose neighbours are found at once, and queries that walk at once; nodes a step looks at, and of how many a walk begins.
SHARD, SOME, FRONT, ENTRIES = 16384, 256, 8, 64


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``id, other, score`` of distinct pairs, by the product of unit vectors."""
    met = pairs.join(rows.select("id", F.col("unit").alias("u")), "id").join(rows.select(F.col("id").alias("other"), F.col("unit").alias("v")), "other")
    product = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return met.select("id", "other", F.round(product, 9).alias("score"))


def _best(scored: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """The ``k`` best rows of each ``id``, ties by the other; in parts first where a list may be long."""
    order = [F.desc("score"), F.asc("other")]
    if parts > 1:
        window = Window.partitionBy("id", F.pmod(F.xxhash64("other"), F.lit(parts))).orderBy(*order)
        scored = scored.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")
    return scored.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """Neighbours of each node and, of the nodes whose neighbour it is, the ``k`` nearest, however many there are."""
    back = _best(graph.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), k, PARTS)
    return graph.unionByName(back).distinct()


def neighbour_graph(rows: DataFrame, k: int = 10, rounds: int = 8, enough: float = 0.01) -> DataFrame:
    """``id, other, score``: about the ``k`` nearest of each row (``id, unit``; ids are distinct).

    Random groups give first neighbours. Each round scores the neighbours of all
    neighbours, in both directions, and keeps the ``k`` best, until less than the share
    ``enough`` of all links is new. A node has at most ``2 * k`` neighbours in a round,
    so work is in proportion to the rows.
    """
    rows = cut(rows.where(F.col("id").isNotNull() & F.col("unit").isNotNull()).select("id", "unit"))
    groups = max(1, rows.count() // (2 * k))
    first = None
    for seed in range(GROUPS):
        dealt = rows.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).alias("g"))
        met = dealt.join(dealt.select("g", F.col("id").alias("other")), "g").where("id <> other").select("id", "other")
        first = met if first is None else first.unionByName(met)
    graph = cut(_best(_scored(first.distinct(), rows), k))
    for _ in range(rounds):
        near = cut(both_ways(graph, k))
        beyond = near.select("id", F.col("other").alias("via")).join(near.select(F.col("id").alias("via"), "other"), "via").where("id <> other").select("id", "other").distinct()
        fresh = beyond.join(graph.select("id", "other"), ["id", "other"], "left_anti")
        grown = cut(_best(graph.unionByName(_scored(fresh, rows)), k))
        new = grown.join(graph.select("id", "other"), ["id", "other"], "left_anti").count()
        graph = grown
        if new <= enough * max(1, groups * 2 * k * k):
            break
    return graph


def beam_search(queries: DataFrame, rows: DataFrame, graph: DataFrame, k: int, beam: int = 32, entries: int = 16, steps: int = 12) -> DataFrame:
    """``query, rank, neighbour, score``: about the ``k`` nearest rows of each query (``id, unit``), itself left out.

    All queries walk at once, from the same few entries. A step looks at the
    neighbours of what each query's ``beam`` holds and has not looked at, and keeps the
    best; a query ends when its beam has nothing new.
    """
    links = cut(both_ways(graph, max(1, beam // 2)).select(F.col("id").alias("at"), "other"))
    asked = cut(queries.where(F.col("id").isNotNull() & F.col("unit").isNotNull()).select("id", "unit"))
    start = rows.where(F.col("id").isNotNull()).orderBy(F.xxhash64("id")).limit(entries).select(F.col("id").alias("other"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(asked.select("id", F.col("unit").alias("u")), "id").join(rows.select(F.col("id").alias("other"), F.col("unit").alias("v")), "other")
        product = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        return met.select("id", "other", F.round(product, 9).alias("score"), F.lit(False).alias("done"))

    held = cut(scored(asked.select("id").crossJoin(F.broadcast(start))))  # a few rows for each query
    for _ in range(steps):
        front = held.where("NOT done").select("id", F.col("other").alias("at"))
        met = front.join(links, "at").select("id", "other").distinct().join(held.select("id", "other"), ["id", "other"], "left_anti")
        new = cut(scored(met))
        if new.isEmpty():
            break
        held = cut(_best(held.withColumn("done", F.lit(True)).unionByName(new), beam))
    best = _best(held.where("id <> other").select("id", "other", "score"), k)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other")))
    return best.select(F.col("id").alias("query"), rank.alias("rank"), F.col("other").alias("neighbour"), "score")


def sharded_search(queries: DataFrame, rows: DataFrame, k: int, links: int = 16, beam: int = 256) -> DataFrame:
    """``query, rank, neighbour, score``: about the ``k`` nearest rows of each query (``id, unit``), itself left out.

    Rows are dealt to shards of about ``SHARD`` by a hash of the id, and each shard has
    a neighbour graph of its own in one task, of the ``links`` nearest in both
    directions. Every query walks every shard's graph by a beam and brings the ``k``
    best, which meet by query. So a vector is shuffled once as a row, and as a query
    once for each shard, never for a pair. Vectors of other lengths don't meet; those
    that hold a null or non-finite component take no part.
    """
    plain = F.forall("unit", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("unit").isNotNull() & (F.size("unit") > 0)).where(plain).select("id", "unit", F.size("unit").alias("width"))
    rows = cut(whole(rows))
    shards = max(1, -(-rows.count() // SHARD))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "width", F.lit(False).alias("asks"), "id", "unit")
    asked = whole(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "width", F.lit(True).alias("asks"), "id", "unit")
    dealt = held.unionByName(asked).repartition(2 * shards, "width", "shard").sortWithinPartitions("width", "shard", "asks", "id")
    kind = rows.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(_walked(k, links, beam), f"id {kind}, other {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other")))
    return found.select(F.col("id").alias("query"), rank.alias("rank"), F.col("other").alias("neighbour"), "score").where(F.col("rank") <= k)


def _links(units: np.ndarray, links: int) -> np.ndarray:
    """Of each row the places of its nearest rows and of the nearest of those whose nearest it is; its own place where there are fewer."""
    n = len(units)
    links = min(links, n - 1)
    near, score = np.empty((n, links), np.int64), np.empty((n, links), np.float32)
    for at in range(0, n, SOME):
        s = units[at : at + SOME] @ units.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        best = np.argpartition(-s, links - 1, axis=1)[:, :links] if links else np.empty((len(s), 0), np.int64)
        near[at : at + SOME], score[at : at + SOME] = best, np.take_along_axis(s, best, 1)
    source, target = np.repeat(np.arange(n), links), near.ravel()
    by = np.lexsort((-score.ravel(), target))
    place = np.arange(len(by)) - np.searchsorted(target[by], target[by])
    by, place = by[place < links], place[place < links]
    back = np.tile(np.arange(n)[:, None], (1, links))
    back[target[by], place] = source[by]
    return np.hstack([near, back])


def _walk(asked: np.ndarray, units: np.ndarray, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores (-inf: none) of the rows that each query's beam ends with."""
    n, q = len(units), len(asked)
    entries = np.arange(0, n, max(1, n // ENTRIES))
    seen = np.zeros((q, n), bool)
    seen[:, entries] = True
    held, score = np.tile(entries, (q, 1)), asked @ units[entries].T
    done = np.zeros(held.shape, bool)
    while True:
        open_ = np.where(done | ~np.isfinite(score), -np.inf, score)
        front = np.argpartition(-open_, min(FRONT, open_.shape[1]) - 1, axis=1)[:, :FRONT]
        some = np.isfinite(np.take_along_axis(open_, front, 1))
        if not some.any():
            return held, score
        np.put_along_axis(done, front, np.take_along_axis(done, front, 1) | some, 1)
        who, column = np.nonzero(some)
        met = (who[:, None] * n + to[held[who, front[who, column]]]).ravel()
        met = np.unique(met[~seen.ravel()[met]])
        seen.ravel()[met] = True
        who, node = np.divmod(met, n)
        begin = np.searchsorted(who, np.arange(q))
        place = np.arange(len(who)) - begin[who]
        new, fresh = np.zeros((q, place.max(initial=-1) + 1), np.int64), np.full((q, place.max(initial=-1) + 1), -np.inf, np.float32)
        new[who, place], fresh[who, place] = node, np.einsum("ij,ij->i", asked[who], units[node])
        held, score, done = np.hstack([held, new]), np.hstack([score, fresh]), np.hstack([done, np.zeros(new.shape, bool)])
        if held.shape[1] > beam:
            best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            held, score, done = (np.take_along_axis(v, best, 1) for v in (held, score, done))


def _walked(k: int, links: int, beam: int):  # noqa: ANN202
    """For ``mapInArrow``: what queries find in their shard; of each shard rows come first, then queries."""

    def vectors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        units = batch.column("unit").combine_chunks() if isinstance(batch, pa.Table) else batch.column("unit")
        return units.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some, made = None, [], None
        for batch in batches:
            width, shard, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("width", "shard", "asks"))
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(width) != 0) | (np.diff(shard) != 0) | (asks[1:] != asks[:-1]))), len(width)) if len(width) else []
            for at, end in zip(cuts, cuts[1:], strict=False):
                run = batch.slice(at, end - at)
                if (width[at], shard[at]) != key:
                    key, some, made = (width[at], shard[at]), [], None
                if not asks[at]:
                    some.append(run)
                    continue
                if made is None:
                    if not some:
                        continue
                    table = pa.Table.from_batches(some)
                    units, some = vectors(table), []
                    narrow = units.astype(np.float32)
                    made = units, narrow, _links(narrow, links), table.column("id").combine_chunks()
                units, narrow, to, ids = made
                for i in range(0, run.num_rows, SOME):
                    yield found(run.slice(i, SOME), units, narrow, to, ids)

    def found(run: pa.RecordBatch, units: np.ndarray, narrow: np.ndarray, to: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        asked = vectors(run)
        held, score = _walk(asked.astype(np.float32), narrow, to, max(beam, 4 * k))
        most = min(2 * k + 2, held.shape[1])
        best = np.argpartition(-score, most - 1, axis=1)[:, :most]
        who, column = np.nonzero(np.isfinite(np.take_along_axis(score, best, 1)))
        node = held[who, best[who, column]]
        exact = np.round(np.einsum("ij,ij->i", asked[who], units[node]), 9)
        who_id, other = run.column("id").take(pa.array(who)), ids.take(pa.array(node))
        own = np.array([a != b for a, b in zip(who_id.to_pylist(), other.to_pylist(), strict=True)], bool)
        order = np.flatnonzero(own)[np.lexsort((node[own], -exact[own], who[own]))]  # rows of a shard are sorted by id
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order = order[place < k]
        return pa.RecordBatch.from_arrays([who_id.take(pa.array(order)), other.take(pa.array(order)), pa.array(exact[order])], ["id", "other", "score"])

    return search
