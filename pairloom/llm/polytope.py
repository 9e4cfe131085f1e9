"""Embedding near-dedup by cross-polytope hashing.

A vector, filled up with zeros to a power of two, is turned by three rounds of
fixed random signs and a fast Hadamard transform; its hash is the coordinate of
largest size with its sign. Two hashes or more make a bucket, so many that unlike
vectors rarely share one, however many there are. Besides its home bucket a
vector probes those that the second largest coordinates give, in all choices.
Vectors meet where the home of one is a home or probe of the other, and only
within their label. A met pair is verified by the cosine in double precision; a
pair that meets in several buckets counts in the first only.

At a cosine of 0.98 two vectors meet in a table with probability 0.95 (64
components) or 0.90 (768) for each hash, so ten tables miss a pair with
probability 1e-9 or 6e-8 by two hashes, 1e-8 or 4e-6 by three.

Equal vectors of a label form a class first, and only classes are hashed. Only
buckets of two or more classes are filled with vectors. A bucket of very many
classes is dealt to blocks that meet pairwise. A task returns a number of links
for each class and a forest of links, never the pairs.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, and neither do rows with a null label; each is its own component.
Vectors of different length don't link. Repeated rows link like any equal vectors; a
null key takes no part: its row is kept with a null component. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.streams import Forest, groups, tasks
from pairloom.operators.components import connected_components
from pairloom.runtime import cut

#: Tables, and hashes of a bucket at least and at most.
TABLES, HASHES = 10, (2, 5)
#: Classes that a task compares with each other.
BLOCK = 1024
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x``, scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def _wide(width: int) -> int:
    """Values of a hash of vectors of ``width`` components."""
    return 2 << max(1, int(np.ceil(np.log2(max(2, width)))))


def hashes_for(rows: int, width: int) -> int:
    """Hashes of a bucket, so that there are about as many buckets as rows."""
    return int(np.clip(np.ceil(np.log2(max(2, rows)) / np.log2(_wide(width))), *HASHES))


def tops(vectors: np.ndarray, hashes: int, tables: int = TABLES) -> np.ndarray:
    """By row, table and hash the largest coordinate and the second, with their signs."""
    wide = _wide(vectors.shape[1])
    width = wide // 2
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    random = np.random.default_rng(SEED)
    out = np.zeros((len(vectors), tables, hashes, 2), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        for h in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * random.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            out[:, t, h] = top + width * (np.take_along_axis(y, top, 1) < 0)
    return out


def homes(found: np.ndarray, wide: int) -> np.ndarray:
    """Code of the home bucket by row and table."""
    return found[..., 0] @ (np.int64(wide) ** np.arange(found.shape[2], dtype=np.int64))


def buckets(found: np.ndarray, wide: int) -> np.ndarray:
    """Codes by row, table and choice of largest and second coordinates; choice 0 is the home."""
    hashes = found.shape[2]
    choice = np.arange(1 << hashes)[:, None] >> np.arange(hashes) & 1
    power = np.int64(wide) ** np.arange(hashes, dtype=np.int64)
    return sum(found[:, :, h, :][:, :, choice[:, h]] * power[h] for h in range(hashes))


def _meets(a: np.ndarray, b: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """First table in which pairs of rows meet (or -1), and the bucket there that counts."""
    home_a, home_b = a[..., :1], b[..., :1]
    at_b, at_a = (home_a == b).any(3).all(2), (home_b == a).any(3).all(2)
    here = at_a | at_b
    table = np.where(here.any(1), here.argmax(1), -1)
    each = np.arange(len(a))
    code_a, code_b = homes(a, wide)[each, table], homes(b, wide)[each, table]
    both, first = (at_a & at_b)[each, table], at_b[each, table]
    return table, np.where(both, np.minimum(code_a, code_b), np.where(first, code_a, code_b))


class Rows:
    """Columns of a frame of whole block pairs as arrays."""

    def __init__(self, frame: pd.DataFrame, kind: str, hashes: int) -> None:
        self.rep, self.weight, self.half, self.table, self.code = (frame[c].to_numpy(np.int64) for c in ("rep", "weight", "half", "tab", "code"))
        self.across = (frame["lo"] != frame["hi"]).to_numpy()
        vectors = np.frombuffer(b"".join(frame["vector"]), kind).reshape(len(frame), -1).astype(np.float64)
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.wide = _wide(vectors.shape[1])
        self.tops = np.frombuffer(b"".join(frame["tops"]), _small(self.wide)).reshape(len(frame), -1, hashes, 2)

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of near rows count here: across blocks if two meet, and in no earlier bucket."""
        kept = np.flatnonzero(~self.across[i] | (self.half[i] != self.half[j]))
        table, code = _meets(self.tops[i[kept]].astype(np.int64), self.tops[j[kept]].astype(np.int64), self.wide)
        return kept[(table == self.table[i[kept]]) & (code == self.code[i[kept]])]


def _small(wide: int) -> str:
    return "<u2" if wide <= 1 << 16 else "<u4"


def _verify(rows: Rows, starts: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row within its block pair (weighted by class size), and forests of them."""
    links = np.zeros(len(rows.rep), np.int64)
    size = np.diff(starts)
    i = starts[:-1][size == 2]  # most buckets hold two classes
    i = i[np.einsum("ij,ij->i", rows.unit[i], rows.unit[i + 1]) >= least]
    i = i[rows.linked(i, i + 1)]
    links[i] += rows.weight[i + 1]
    links[i + 1] += rows.weight[i]
    found = list(zip(rows.rep[i].tolist(), rows.rep[i + 1].tolist(), strict=True))
    for a, b in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
        forest = Forest(b - a)
        for i in range(a, b - 1):
            near = i + 1 + np.flatnonzero(rows.unit[i + 1 : b] @ rows.unit[i] >= least)
            if len(near):
                near = near[rows.linked(np.full(len(near), i), near)]
                links[i] += rows.weight[near].sum()
                links[near] += rows.weight[i]
                found += [(int(rows.rep[i]), int(rows.rep[j])) for j in near.tolist() if forest.join(i - a, j - a)]
    return links, found


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row."""
    doubles = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), doubles.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("v", lambda x: x == 0)
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & ~zero
    rows = rows.withColumn("class", F.when(F.coalesce(good, F.lit(False)), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    rows = cut(rows)
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    known = rows.agg(F.count("class").alias("n"), F.max(F.size("v")).alias("width")).first()
    hashes = hashes_for(known["n"], known["width"] or 1)
    kind = "<f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "<f8"  # floats are doubles exactly

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["v"].map(len)):
                x = np.stack(part["v"].to_numpy()).astype("<f8")
                found, wide = tops(x / np.linalg.norm(x, axis=1, keepdims=True), hashes), _wide(x.shape[1])
                yield pd.DataFrame({
                    "class": part["class"], "rep": part["rep"], "weight": part["weight"], "place": part["place"] + f"|{width}",
                    "vector": [r.astype(kind).tobytes() for r in x], "tops": [r.astype(_small(wide)).tobytes() for r in found], "list": list(buckets(found, wide).reshape(len(x), -1)),
                })

    coded = classes.select("class", "rep", "weight", F.col("label").cast("string").alias("place"), "v")
    coded = coded.mapInPandas(hashed, "class string, rep long, weight long, place string, vector binary, tops binary, list array<long>")
    coded = cut(coded.withColumn("c", F.monotonically_increasing_id()))
    met = coded.select("c", "place", F.posexplode("list").alias("at", "code"))
    met = met.withColumn("tab", F.floor(F.col("at") / (1 << hashes)).cast("int")).withColumn("home", F.col("at") % (1 << hashes) == 0)
    met = cut(met.select("c", F.xxhash64("place", "tab", "code").alias("bucket"), "tab", "code", "home"))
    full = met.groupBy("bucket").agg(F.count("*").alias("members"), F.max("home").alias("some")).where("members > 1 AND some")
    full = cut(full.select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    dealt = met.join(full, "bucket").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # blocks i < j meet as (i, j), a block with itself as (i, i)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", "bucket", "tab", "code", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("half"))
    whole = dealt.join(coded.select("c", "rep", "weight", "vector", "tops"), "c").drop("c")
    key_of = ["bucket", "lo", "hi"]
    whole = whole.repartition(tasks(whole), *key_of).sortWithinPartitions(*key_of, "rep")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _ in groups(batches, key_of):
            for _, part in frame.groupby(frame["vector"].map(len), sort=False):  # a bucket holds one width
                keys = part[key_of]
                starts = np.append(np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()), len(part))
                rows = Rows(part, kind, hashes)
                links, forest = _verify(rows, starts, least)
                some = np.flatnonzero(links)
                out = pd.DataFrame({"a": rows.rep[some], "b": pd.array([None] * len(some), "Int64"), "links": links[some]})
                tree = pd.DataFrame(forest, columns=["a", "b"], dtype=np.int64).astype({"b": "Int64"}).assign(links=0)
                yield pd.concat([out, tree])

    found = cut(whole.mapInPandas(verified, "a long, b long, links long"))
    number = found.groupBy("a").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = coded.select("class", "rep", "weight").join(number, F.col("rep") == F.col("a"), "left").join(component, F.col("rep") == F.col("node"), "left")
    known = cut(known.select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = rows.select("id", "class").join(known, "class", "left")
    component_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))
