"""Vectors: pooling, exact nearest neighbours in blocks, cell index, candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.similarity import norm
from pairloom.runtime import cut

#: Rows of a block, of either side, and queries of it that are scored at once.
BLOCK, SCORED = 4096, 128


def pool(chunks: DataFrame, key: str, vector: str, how: str = "avg") -> DataFrame:
    """One vector per key: the mean or the maximum of each component, not scaled."""
    parts = chunks.select(key, F.posexplode(vector).alias("place", "x"))
    each = parts.groupBy(key, "place").agg((F.avg if how == "avg" else F.max)(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"])
    return each.groupBy(key).agg(ordered.alias("pooled"))


def normalised(rows: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    """Vectors of length 1; a zero vector stays."""
    length = norm(F.col(vector))
    return rows.withColumn(out, F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double"))))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, least: float = -1.0, exclude: str | None = None) -> DataFrame:
    """``query, neighbour, score``: the ``k`` best cosines of each query of at least ``least``; ties by id.

    Both tables have ``id`` and ``unit`` (and the column ``exclude``: rows that
    agree in it don't match). Blocks of queries meet blocks of the corpus; each
    pair of blocks keeps its ``k`` best, which then meet by query.
    """
    mark = F.col(exclude) if exclude else F.col("id")
    q = queries.select(F.col("id").alias("qid"), F.col("unit").alias("qunit"), mark.cast("string").alias("qmark"))
    c = corpus.select("id", "unit", mark.cast("string").alias("mark"))
    nq, nc = (max(1, -(-df.count() // BLOCK)) for df in (q, c))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.select(F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("qb"), each(nc).alias("cb"), "*")
    right = c.select(F.pmod(F.xxhash64("id"), F.lit(nc)).alias("cb"), each(nq).alias("qb"), "*")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "score": []})
        return block_nearest(a, b.sort_values("id", ignore_index=True), k, least)

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(best, "query long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def block_nearest(a: pd.DataFrame, b: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """The nearest of a block, sorted by id, for a block of queries, a few of which are scored at once."""
    queries, units, ids = np.stack(a["qunit"].to_numpy()), np.stack(b["unit"].to_numpy()), b["id"].to_numpy()
    names, own, asked = b["mark"].to_numpy(), a["qmark"].to_numpy(), a["qid"].to_numpy()
    made = []
    for at in range(0, len(a), SCORED):
        scores = queries[at : at + SCORED] @ units.T
        scores[own[at : at + SCORED, None] == names[None, :]] = -np.inf
        order = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(order)), order.shape[1])
        some = pd.DataFrame({"query": asked[at + rows], "neighbour": ids[order.ravel()], "score": scores[rows, order.ravel()]})
        made.append(some[np.isfinite(some["score"]) & (some["score"] >= least)])
    return pd.concat(made)


def candidate_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs that either side's neighbours give, each once."""
    return near.select(F.least("query", "neighbour").alias("doc_a"), F.greatest("query", "neighbour").alias("doc_b")).distinct()


def cell_index(corpus: DataFrame, cells: int, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """Each row with its nearest of ``cells`` centres (k-means), and the centres."""
    rows = corpus.withColumn("features", array_to_vector("unit"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(rows)
    placed = model.transform(rows).withColumnRenamed("prediction", "cell").drop("features")
    return placed, [list(map(float, x)) for x in model.clusterCenters()]


def enough_probes(queries: DataFrame, placed: DataFrame, centres: list[list[float]], k: int, target: float = 0.95, sample: int = 400) -> int:
    """The least number of probes whose recall against brute force reaches ``target``, measured on a sample of the queries."""
    asked = cut(queries.select("id", "unit").orderBy(F.xxhash64("id")).limit(sample))
    near = nearest(asked, placed, k).join(asked.select(F.col("id").alias("query"), "unit"), "query").join(placed.select(F.col("id").alias("neighbour"), "cell"), "neighbour")
    matrix = np.array(centres)

    @F.pandas_udf("int")
    def place(unit: pd.Series, cell: pd.Series) -> pd.Series:
        """Cells that are nearer to the query than the neighbour's."""
        away = (matrix * matrix).sum(1) - 2 * np.stack(unit.to_numpy()) @ matrix.T  # less the query's own norm, the same for all cells
        return pd.Series((np.argsort(away, axis=1, kind="stable") == cell.to_numpy()[:, None]).argmax(1))

    found = {r["place"]: r["count"] for r in near.groupBy(place("unit", "cell").alias("place")).count().collect()}  # a row for each cell at most
    total, reached = sum(found.values()), 0
    for probes in range(len(centres)):
        reached += found.get(probes, 0)
        if reached >= target * total:
            return probes + 1
    return len(centres)


def probe_search(queries: DataFrame, placed: DataFrame, centres: list[list[float]], k: int, probes: int) -> DataFrame:
    """Approximate neighbours: only rows of the ``probes`` cells nearest to a query are scored."""
    matrix = np.array(centres)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.argsort(((np.stack(batch["unit"].to_numpy())[:, None, :] - matrix[None]) ** 2).sum(2), axis=1)[:, :probes]
                yield pd.DataFrame({"id": batch["id"], "unit": batch["unit"], "cells": list(near)})

    asked = queries.select("id", "unit").mapInPandas(cells, "id long, unit array<double>, cells array<int>")
    asked = asked.select(F.col("id").alias("qid"), F.col("unit").alias("qunit"), F.explode("cells").alias("cell"))
    rows = placed.select("id", "unit", F.col("cell").cast("int").alias("cell"))
    # a cell is dealt to parts of about a block; blocks of its queries meet each of them
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    nq = max(1, -(-queries.count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.join(F.broadcast(parts), "cell").select("cell", each(F.col("parts")).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"), "qid", "qunit", F.col("qid").cast("string").alias("qmark"))  # a row for each cell
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each cell
    right = dealt.select("cell", "part", each(F.lit(nq)).alias("qb"), "id", "unit", F.col("id").cast("string").alias("mark"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "score": []})
        return block_nearest(a, b.sort_values("id", ignore_index=True), k, -np.inf)

    keys = ["cell", "part", "qb"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """Rows with their cluster."""
    made = rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed).fit(made).transform(made).withColumnRenamed("prediction", "cluster").drop("features")


def hashing_encoder(docs: DataFrame, key: str, words: str, dim: int = 128) -> DataFrame:
    """Model-free vectors: each word adds to the component its SHA-256 names, later words a little more; length 1.

    It tells shared words, not meaning.
    """
    w = docs.select(key, F.posexplode(words).alias("place", "word"))
    slot = F.conv(F.substring(F.sha2("word", 256), 57, 8), 16, 10).cast("long") % dim
    parts = w.groupBy(key, slot.alias("slot")).agg(F.sum(1 + 0.01 * F.col("place")).alias("x"))
    parts = cut(parts)
    length = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return parts.join(length, key).select(key, "slot", (F.col("x") / F.col("len")).alias("x"))


