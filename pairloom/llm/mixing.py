"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in an order given by a hash of their keys; their words,
end to end, are cut into blocks. A source gives as many blocks as its target asks
for, drawn in a permuted order: once all, then again all, in another order, up to
the target, whose last block is cut to the word. So a source gives its target
exactly, and no word comes more often than others of its source by more than one.

The numbers of draws of all sources are the quotas of a tree over the output
shards. A node splits its shards in halves and its quotas by one draw from the
multivariate hypergeometric distribution, as if all draws had been shuffled and cut
in two; what lies before a node is handed down, so that a shard knows which draws of
a source are its own. Shards draw disjoint blocks; the pieces of a shard are then
shuffled in it. Every random number comes from a seed and the node's place, so
reruns agree. A node holds a number for each source: sources are as many as a table
of weights has rows. Texts are read once, for their sizes.

Null text has no words; documents without words have no piece and take nothing. A
null source is a source of its own, after all others. A null key is one more key.
Repeated rows are further documents. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.streams import tasks
from pairloom.operators.ranges import running
from pairloom.runtime import cut

SEED = 12
#: Words of a block at least, of a shard about; draws in all at most, which numpy's distribution asks for.
BLOCK, SHARD, DRAWS = 512, 1 << 20, 1 << 29
#: Levels of the tree that one task goes down from a node.
LEVELS = 10
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words of each source: ``share`` of all sizes by weight, none above ``most`` times its size."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    out, still = np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while still.any():
        asked = left * weight / weight[still].sum()
        above = still & (asked > most * size)
        if not above.any():
            out[still] = asked[still]
            break
        out[above] = most * size[above]
        left -= out[above].sum()
        still &= ~above
    return out.tolist()


def _coprime(rng: np.random.Generator, n: int) -> int:
    while True:
        a = int(rng.integers(1, n + 1))
        if np.gcd(a, n) == 1:
            return a


def draws_of(number: int, size: int, take: int, block: int, epochs: int) -> list[dict]:
    """For each epoch of a source the order of its blocks and how many are drawn.

    Block ``b`` is draw ``(factor * b + shift) % blocks``. As the documents stand in
    a random order already, that is enough to deal out blocks evenly.
    """
    blocks, out, before = -(-size // block), [], 0
    for epoch in range(epochs):
        words = min(size, max(0, take - epoch * size))
        if not words:
            break
        rng = np.random.default_rng([SEED, number, epoch])
        factor, shift = _coprime(rng, blocks), int(rng.integers(0, blocks))
        short = (factor * (blocks - 1) + shift) % blocks  # the draw of the last block, which may be short
        missing = blocks * block - size
        drawn = -(-words // block) if words <= short * block else max(short + 1, -(-(words + missing) // block))
        out.append({"epoch": epoch, "blocks": blocks, "factor": factor, "shift": shift, "short": short, "missing": missing, "words": words, "before": before, "drawn": drawn})
        before += drawn
    return out


def _split(nodes: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes ``LEVELS`` levels below, or shards: places, quotas, and what of each source lies before."""
    for frame in nodes:
        for first, shards, quotas, before in zip(*(frame[c] for c in ("first", "shards", "quotas", "before")), strict=True):
            level = [(int(first), int(shards), np.array(quotas, np.int64), np.array(before, np.int64))]
            for _ in range(LEVELS):
                below = []
                for at, n, quota, done in level:
                    if n == 1:
                        below.append((at, n, quota, done))
                        continue
                    half = n // 2
                    rng = np.random.default_rng([SEED, at, n])
                    left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * half // n, method="marginals")
                    below += [(at, half, left, done), (at + half, n - half, quota - left, done + left)]
                level = below
            yield pd.DataFrame(level, columns=["first", "shards", "quotas", "before"])


def shard_quotas(like: DataFrame, quotas: list[int], shards: int) -> DataFrame:
    """``first, quotas, before`` of each shard, from the root down."""
    spark = like.sparkSession
    kind = "first long, shards long, quotas array<long>, before array<long>"
    nodes = spark.createDataFrame([(0, shards, quotas, [0] * len(quotas))], kind)
    made = 1
    while made < shards:
        nodes = nodes.mapInPandas(_split, kind)
        made <<= LEVELS
        if made < shards:
            nodes = nodes.repartition(tasks(like), "first")
    return nodes


def mix(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2) -> tuple[DataFrame, DataFrame]:
    """Documents, ``row, key, size, source_size, target``, and the pieces drawn of them, ``row, shard, position, epoch, start, length``.

    Sources by code point, null last, take ``weights`` in turn.
    """
    spark = docs.sparkSession
    counted = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    counted = cut(counted.withColumn("row", F.monotonically_increasing_id()))
    known = counted.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
    known = sorted(((r["source"], r["size"]) for r in known), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in known]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(known))], share, most)
    take = [min(int(t + 0.5), int(most * n)) for t, n in zip(target, sizes, strict=True)]
    block = max(BLOCK, -(-sum(take) // DRAWS))
    base = np.cumsum([0, *sizes]).tolist()
    facts = [(s, i, n, t, base[i]) for i, ((s, n), t) in enumerate(zip(known, target, strict=True))]
    kind = docs.schema[source].dataType.simpleString()
    sources = spark.createDataFrame(facts, f"source {kind}, number int, source_size long, target double, base long")
    epochs = [[number, *e.values()] for number, n in enumerate(sizes) for e in draws_of(number, n, take[number], block, int(np.ceil(most)))]
    names = ("epoch", "blocks", "factor", "shift", "short", "missing", "words", "before", "drawn")
    orders = spark.createDataFrame(epochs, "number int, " + ", ".join(f"{c} long" for c in names))
    few = len(known) <= 100_000
    sent = F.broadcast if few else (lambda x: x)
    rows = counted.join(sent(sources), counted["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("place", F.struct("number", F.xxhash64(F.lit(SEED), "key").alias("h"), "key", "size"))
    rows = cut(running(rows, "place", F.col("size"), "at").withColumn("at", F.col("at") - F.col("base")))

    # pieces of documents in blocks, and where each block is drawn
    begin, end = F.greatest("at", F.col("b") * block), F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block)
    blocks = rows.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    pieces = blocks.select("row", "number", "b", (begin - F.col("at")).alias("start"), (begin - F.col("b") * block).alias("inner"), (end - begin).alias("length"))
    drawn = pieces.join(sent(orders), "number").withColumn("draw", (F.col("factor") * F.col("b") + F.col("shift")) % F.col("blocks"))
    ahead = F.col("draw") * block - F.when(F.col("draw") > F.col("short"), F.col("missing")).otherwise(0)
    drawn = drawn.withColumn("length", F.least("length", F.col("words") - ahead - F.col("inner"))).where("length > 0")
    drawn = drawn.select("row", "number", "epoch", "start", "inner", "length", (F.col("draw") + F.col("before")).alias("draw"))

    quotas = [0] * len(known)
    for number, *values in epochs:
        quotas[number] += values[-1]
    shards = shard_quotas(docs, quotas, max(1, -(-sum(take) // SHARD)))
    owned = shards.select(F.col("first").alias("shard"), F.posexplode(F.arrays_zip("quotas", "before")).alias("number", "x")).where("x.quotas > 0")
    owned = owned.select("shard", "number", F.explode(F.sequence(F.col("x.before"), F.col("x.before") + F.col("x.quotas") - 1)).alias("draw"))
    placed = drawn.join(owned, ["number", "draw"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "shard", "number", "draw", "inner"), "number", "draw", "inner")
    placed = placed.withColumn("position", F.row_number().over(order).cast("long") - 1)  # a shard is bounded
    return rows.select("row", "key", "size", "source_size", "target"), placed.select("row", "shard", "position", "epoch", "start", "length")


def taken(rows: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """``key, size, source_size, target, taken, pieces`` of each document; its pieces as text, ``shard:start:length`` by epoch and start."""
    each = pieces.groupBy("row").agg(F.sum("length").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "start", "shard", "length"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: F.concat_ws(":", x["shard"], x["start"], x["length"])), ",")
    out = rows.join(each.select("row", "taken", text.alias("pieces")), "row", "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.lit("")).alias("pieces"))
