"""Near-duplicate documents with HyperMinHash sketches.

1. A document's set is its distinct five-word shingles. Documents with equal sets
   form a class; one of it stands for all from here on.
2. A sketch has 64 registers of 16 bits. Each shingle falls into one register by
   its hash; the register keeps the least hash, compressed to its count of
   leading zeros and the ten bits after the leading one.
3. Bands of four registers give buckets. In a bucket, the share of equal registers,
   less the equal ones to be expected by chance, estimates Jaccard similarity; a
   pair six standard errors below the threshold is no candidate. A bucket yields
   a forest over its candidate pairs, never the pairs themselves. Components of
   all forests are clusters; any two documents that could be linked are in one
   cluster.
4. Full sets are computed once more for clustered classes only, brought together by
   cluster, and links confirmed on them. Again only forests leave a task.
5. Components of the confirmed links are the result.

A bucket or cluster of more rows or shingles than a task should hold is dealt to
blocks. Each block is first compared in itself, with a few pivots that all blocks
share; a row is labelled by a pivot that it is connected with. Rows without the
most frequent label of their group are
dealt to blocks of their own, which meet each other and all blocks of the rest two
by two, so a task never holds more than two blocks.

With 16 bands of four registers, a pair of similarity 0.85 misses all buckets with
probability 7e-6, one of 0.8 with 2e-4.

A null text, or one without words, has an empty set and is linked with nothing.
Repeated rows are linked like any equal texts. A null key takes no part: the row
is kept with a null component. Columns other than key and text are ignored; an
empty table gives no rows. Links are confirmed on sets of 64-bit hashes of whole
shingles: of two different shingles the hashes are equal with probability 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shingles import shingle_set
from pairloom.llm.streams import Forest, groups, small, tasks
from pairloom.operators.components import connected_components
from pairloom.runtime import cut

REGISTERS, MANTISSA, ROWS = 64, 10, 4
BANDS = REGISTERS // ROWS
#: Rows of a block of a bucket, rows and shingles of a block of a cluster, about; pivots that the blocks of one share.
BUCKET, BLOCK_ROWS, BLOCK_SHINGLES, PIVOTS = 1024, 256, 1_000_000, 16
#: Rows of a group up to which all its pairs are estimated at once.
FEW = 12
ERRORS = 6.0


def registers(sets: np.ndarray) -> np.ndarray:
    """Sketch of a sorted set of 64-bit hashes; 0 is an empty register."""
    first = np.searchsorted(sets, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(58))
    out = np.zeros(REGISTERS, np.uint16)
    there = np.flatnonzero(np.diff(np.append(first, len(sets))) > 0)
    rest = sets[first[there]] << np.uint64(6)
    zeros = np.where(rest > 0, 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1], 58).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(52))
    after = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[there] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | after
    return out


def by_chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of ``a`` and ``b`` shingles are equal."""
    x, y = a / REGISTERS, b / REGISTERS
    total = np.zeros(np.broadcast(x, y).shape)
    for i in range(1, 54):  # leading zeros: a cell of that octave is 2^-i / 2^MANTISSA wide
        low = 2.0**-i
        total += x * y * (low / (1 << MANTISSA)) * (np.exp(-(x + y) * low) - np.exp(-(x + y) * 2 * low)) / (x + y)
    return total


def estimate(equal: np.ndarray, either: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches, corrected for chance collisions."""
    chance = by_chance(a, b)
    share = equal / np.maximum(either, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float, either: np.ndarray) -> np.ndarray:
    return threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(either, 1))


def candidates(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows ``i`` and ``j`` are candidates, pair by pair."""
    x, y, n, m = sketch[i], sketch[j], size[i], size[j]
    there = (x > 0) | (y > 0)
    equal, either = ((x == y) & there).sum(1), there.sum(1)
    likely = (equal / np.maximum(either, 1) >= least_estimate(threshold, either)) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
    kept = np.flatnonzero(likely)
    good = estimate(equal[kept], either[kept], n[kept].astype(float), m[kept].astype(float)) >= least_estimate(threshold, either[kept])
    likely[kept] = good
    return likely


def forest_of(order: np.ndarray, side: np.ndarray, part: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], Forest]:
    """Links that join the rows of a group, of which no more than a forest is kept, and the forest.

    Rows of equal ``part`` are known to be connected. Rows of side 0 and of side 1
    meet the other side only, rows of side -1 meet all. ``linked`` tells which of
    some rows that stand later in ``order`` are linked with a row.
    """
    forest = Forest(len(order))
    _, first = np.unique(part, return_inverse=True)
    seen: dict[int, int] = {}
    for i, p in enumerate(first.tolist()):
        forest.join(seen.setdefault(p, i), i)
    found = []
    for at, i in enumerate(order.tolist()):
        roots = forest.roots()
        others = order[at + 1 :]
        others = others[(roots[others] != roots[i]) & ((side[others] != side[i]) | (side[i] < 0))]
        if len(others):
            found += [(i, j) for j in others[linked(i, others)].tolist() if forest.join(i, j)]
    return found, forest


#: What tasks return: links (kind 0), and of rows of large groups (kind 1) the label ``b`` of ``a``.
FOUND = "kind int, grp long, a long, b long"


def _found(links: list[tuple[int, int]] | np.ndarray, labels: list[tuple[int, int, int]]) -> pd.DataFrame:
    ends = np.array(links, np.int64).reshape(-1, 2)
    own = np.array(labels, np.int64).reshape(-1, 3)
    kind = np.repeat(np.array([0, 1], np.int32), [len(ends), len(own)])
    return pd.DataFrame({"kind": kind, "grp": np.concatenate((np.zeros(len(ends), np.int64), own[:, 0])), "a": np.concatenate((ends[:, 0], own[:, 1])), "b": np.concatenate((ends[:, 1], own[:, 2]))})


def _labels(group: pd.DataFrame, forest: Forest) -> list[tuple[int, int, int]]:
    """For each row whose home is this block a row that it is connected with: the least pivot, if there is one, else the least of all."""
    rep, pivot, home = group["rep"].to_numpy(np.int64), group["pivot"].to_numpy(), group["home"].to_numpy()
    roots = forest.roots()
    label: dict[int, tuple[bool, int]] = {}
    for i, root in enumerate(roots.tolist()):
        label[root] = min(label.get(root, (True, int(rep[i]))), (not pivot[i], int(rep[i])))
    grp = int(group["grp"].iloc[0])
    return [(grp, int(rep[i]), label[int(roots[i])][1]) for i in np.flatnonzero(home).tolist()]


def bucket_forests(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Forests over the candidate pairs of blocks; rows are sorted by ``grp`` and ``block``."""
    threshold = percent / 100
    for frame, starts in groups(batches, ["grp", "block"]):
        rep, size, side, part = (frame[c].to_numpy(np.int64) for c in ("rep", "n", "side", "part"))
        sketch = np.frombuffer(b"".join(frame["sketch"]), "<u2").reshape(len(frame), REGISTERS)
        begin, members = starts[:-1], np.diff(starts)
        large = np.logical_or.reduceat(frame["pivot"].to_numpy(), begin)
        found: list[tuple[int, int]] = []
        labels: list[tuple[int, int, int]] = []
        joined = Forest(len(frame))
        for few in range(2, FEW + 1):  # most groups have two or three rows
            i, j = ((begin[(members == few) & ~large][:, None] + x).ravel() for x in np.triu_indices(few, 1))
            open_ = (part[i] != part[j]) & ((side[i] != side[j]) | (side[i] < 0))
            i, j = i[open_], j[open_]
            hit = candidates(sketch, size, i, j, threshold)
            found += [(x, y) for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True) if joined.join(x, y)]
        for at in np.flatnonzero((members > FEW) | large).tolist():
            a, b = int(starts[at]), int(starts[at + 1])

            def linked(i: int, others: np.ndarray, a: int = a) -> np.ndarray:
                return candidates(sketch, size, np.full(len(others), a + i), a + others, threshold)

            links, forest = forest_of(np.arange(b - a), side[a:b], part[a:b], linked)
            found += [(a + i, a + j) for i, j in links]
            if large[at]:
                labels += _labels(frame.iloc[a:b], forest)
        yield _found(rep[np.array(found, np.int64).reshape(-1, 2)], labels)


def set_forests(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Forests over the links of blocks, confirmed on full sets; rows are sorted by ``grp`` and ``block``."""
    for frame, starts in groups(batches, ["grp", "block"]):
        found, labels = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rep, side, part = (frame[c].to_numpy(np.int64)[a:b] for c in ("rep", "side", "part"))
            sets = [np.frombuffer(x, "<u8") for x in frame["hashes"].iloc[a:b]]
            size = np.array([len(s) for s in sets])
            begin = np.concatenate(([0], np.cumsum(size)))
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(code) and int(code.max()) + 1, bool)

            def linked(i: int, others: np.ndarray, size=size, begin=begin, code=code, mark=mark) -> np.ndarray:
                own = code[begin[i] : begin[i + 1]]
                mark[own] = True
                out = 100 * size[others] >= percent * size[i]
                for at in np.flatnonzero(out).tolist():
                    j = others[at]
                    shared = int(np.count_nonzero(mark[code[begin[j] : begin[j + 1]]]))
                    out[at] = 100 * shared >= percent * (size[i] + size[j] - shared)
                mark[own] = False
                return out

            links, forest = forest_of(np.argsort(-size, kind="stable"), side, part, linked)
            found += [(rep[i], rep[j]) for i, j in links]
            if frame["pivot"].iloc[a:b].any():
                labels += _labels(frame.iloc[a:b], forest)
        yield _found(found, labels)


def sketches(text: Column) -> Column:
    """Struct of the set's size, its identity (16 bytes) and its sketch."""

    @F.pandas_udf("struct<n:long,same:binary,sketch:binary>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                s = shingle_set(t)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).astype("<u2").tobytes()))
            yield pd.DataFrame(rows, columns=["n", "same", "sketch"])

    return made(text)


def full_sets(text: Column) -> Column:
    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t).astype("<u8").tobytes() for t in batch])

    return made(text)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row of ``docs``.

    Links have ``100 * shared >= percent * union``. ``key`` is a whole number.
    """
    body = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketched = cut(body.select("id", sketches(F.col("text")).alias("s")).select("id", "s.n", "s.same", "s.sketch"))
    classes = cut(
        sketched.where("n > 0 AND id IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    clusters = _clusters(classes, percent)
    links = _links(body, clusters, percent)
    component = cut(connected_components(links))
    of_class = classes.select("same", "rep").join(component, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component"))
    of_class = cut(of_class)
    # rows without a set or key stay by themselves, and apart from each other in the join
    joins = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("same"))
    out = sketched.select("id", "n", joins.alias("joins")).join(of_class, F.col("joins") == F.col("same"), "left")
    component_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def _blocks(groups: DataFrame, rows: int, weight: int | None = None) -> DataFrame:
    """Number of blocks for each group (``grp``, ``members``, ``weight``) of two or more rows."""
    number = F.ceil(F.col("members") / rows)
    if weight is not None:
        number = F.greatest(number, F.ceil(F.col("weight") / weight))
    return cut(groups.where("members > 1").select("grp", number.cast("long").alias("blocks")))


def _clusters(classes: DataFrame, percent: int) -> DataFrame:
    """``node, component``: clusters of classes that may be linked."""
    band = F.expr(f"filter(transform(sequence(0, {BANDS - 1}), i -> struct(i, substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS}) AS part)), x -> x.part != unhex('{'00' * 2 * ROWS}'))")
    keyed = cut(classes.select("rep", F.explode(band).alias("x")).select("rep", F.xxhash64("x.i", "x.part").alias("grp")))
    blocks = _blocks(keyed.groupBy("grp").agg(F.count("*").alias("members")), BUCKET)
    rows = keyed.join(blocks, "grp").join(classes.select("rep", "n", "sketch"), "rep")
    return cut(connected_components(_block_links(rows, ["n", "sketch"], lambda b: bucket_forests(b, percent), blocks, BUCKET)))


def _links(body: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Confirmed links within clusters, as a forest."""
    # a class is read from any one row with its key; equal keys may have several texts, so the set tells
    found = body.join(small(clusters), F.col("id") == F.col("node")).select(F.col("id").alias("rep"), F.col("component").alias("grp"), full_sets(F.col("text")).alias("hashes"))
    # cut before the filter, which Spark would else push below the join, with the sets of all texts
    sets = cut(found.distinct()).where(F.octet_length("hashes") > 0).withColumn("weight", F.octet_length("hashes") / 8)
    blocks = _blocks(sets.groupBy("grp").agg(F.count("*").alias("members"), F.sum("weight").alias("weight")), BLOCK_ROWS, BLOCK_SHINGLES)
    return _block_links(sets.join(blocks, "grp"), ["hashes", "weight"], lambda b: set_forests(b, percent), blocks, BLOCK_ROWS, BLOCK_SHINGLES)


def _block_links(rows: DataFrame, payload: list[str], forests: Callable, blocks: DataFrame, most_rows: int, most_weight: int | None = None) -> DataFrame:
    """Forests of links within the groups of ``rows`` (``grp, blocks, rep`` and the payload)."""

    def run(placed: DataFrame) -> DataFrame:
        placed = placed.select("grp", "block", "rep", "side", "part", "pivot", "home", *payload)
        placed = placed.repartition(tasks(placed), "grp", "block").sortWithinPartitions("grp", "block", "rep")
        return cut(placed.mapInPandas(forests, FOUND))

    def alone(placed: DataFrame, pivot: bool = False, home: bool = True) -> DataFrame:
        return placed.withColumns({"side": F.lit(-1), "part": F.col("rep"), "pivot": F.lit(pivot), "home": F.lit(home)}).select("grp", "block", "rep", "side", "part", "pivot", "home", *payload)

    own = F.pmod(F.xxhash64("rep", payload[0]), F.col("blocks"))
    if blocks.where("blocks > 1").isEmpty():
        return run(alone(rows.withColumn("block", F.lit(0).cast("long")))).select("a", "b")
    # the row of the least key of each share of a large group is a pivot
    many = cut(rows.where("blocks > 1").withColumn("own", own))
    least = many.groupBy("grp", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("share")).agg(F.min("rep").alias("rep")).select("grp", "rep")
    pivots = cut(many.join(least, ["grp", "rep"])).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    few = rows.where("blocks = 1").withColumn("block", F.lit(0).cast("long"))
    # a pivot stands in its own block twice, once for its home
    first = alone(few).unionByName(alone(many.withColumn("block", F.col("own")))).unionByName(alone(pivots, pivot=True, home=False))
    made = run(first)
    links = made.where("kind = 0").select("a", "b")
    label = made.where("kind = 1").groupBy("grp", F.col("a").alias("rep")).agg(F.min("b").alias("part"))
    parts = cut(many.join(label, ["grp", "rep"]))
    weight = F.sum("weight") if most_weight is not None else F.lit(0)
    size = parts.groupBy("grp", "part").agg(F.count("*").alias("members"), weight.alias("weight"))
    main = size.groupBy("grp").agg(
        F.max_by("part", F.struct("members", "part")).alias("main"), F.count("*").alias("number"),
        (F.sum("members") - F.max("members")).alias("members"), F.sum("weight").alias("weight"),
    )
    apart = main.where("number > 1")
    number = F.ceil(F.col("members") / most_rows)
    if most_weight is not None:
        number = F.greatest(number, F.ceil(F.col("weight") / most_weight))
    apart = cut(apart.select("grp", "main", number.cast("long").alias("others")))
    if apart.isEmpty():
        return links
    split = parts.join(apart, "grp").withColumn("other", F.when(F.col("part") != F.col("main"), F.pmod(F.xxhash64("rep", F.lit("other")), F.col("others"))))
    each = lambda number: F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))
    block = lambda lo, hi: lo * F.lit(1 << 31) + F.col("blocks") + hi
    minor, major = split.where("other IS NOT NULL"), split.where("other IS NULL").drop("other")
    wide = major.withColumn("meets", each("others")).withColumns({"block": block(F.col("own"), F.col("meets")), "side": F.lit(0)})
    across = minor.withColumn("meets", each("blocks")).withColumns({"block": block(F.col("meets"), F.col("other")), "side": F.lit(1)})
    between = minor.withColumn("meets", each("others")).withColumns({
        "block": block(F.col("blocks") + F.least("meets", "other"), F.greatest("meets", "other")),
        "side": F.when(F.col("meets") == F.col("other"), -1).when(F.col("other") < F.col("meets"), 0).otherwise(1),
    })
    more = [x.withColumns({"pivot": F.lit(False), "home": F.lit(False)}).select("grp", "block", "rep", "side", "part", "pivot", "home", *payload) for x in (wide, across, between)]
    return links.unionByName(run(more[0].unionByName(more[1]).unionByName(more[2])).select("a", "b"))
