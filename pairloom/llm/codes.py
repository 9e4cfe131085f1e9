"""Vector code compression by Lloyd rounds over cover trees.

Components become whole numbers ``floor(scale * x)``; a vector is cut into equal
parts, each with a codebook. A task takes some rows at a time and builds a cover
tree of each part of them: a farthest-first walk gives nested nets of points whose
radii halve, each point of a net hangs on its nearest point of the net above, and
each of the remaining points on its nearest net point. A node has the number and
the sum of the points below it and their largest distance. Trees are built once,
written, and used by every round.

A round sends the codebooks down all trees, a level at a time. By the triangle
inequality an entry that is farther from a node's centre than the nearest one by
more than twice the node's radius is nearest to none of its points. Where one entry
is left, the whole subtree is assigned to it by its number and sum; else its
children are looked at, with the entries left. Only points below the last
ambiguous nodes are compared with entries one by one, in whole numbers, ties to the
lower index. Distances of the bounds are rounded, so a margin is kept that only
sends more points to exact comparison.

Sums leave a task once, as one number for each entry and position. What reaches the
driver is the codebooks, whose size is ``entries`` times the vector's length.

Vectors that are null, empty, or hold null or non-finite components take no part
and have no row. All others must be of one length, a multiple of ``parts``, and
components within 2^26 after scaling: anything else raises. Repeated rows count
each time. A null key comes last, equal keys by their vectors, when the first rows
are taken as the codebooks' beginning; with fewer rows than ``entries`` there are
fewer entries. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.streams import small
from pairloom.runtime import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a tree, net points of the finest net at most, levels.
ROWS, NET, LEVELS = 4096, 256, 12
#: Scaled components are at most so large, so that squared distances are exact.
LARGEST = 1 << 26


def farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Net points by part, their insertion distances, and the nearest of them for each point.

    ``points`` is part, point, component. Each net point is the farthest point from
    those before it, so the first so many of any radius are a net of that radius.
    """
    parts, n, _ = points.shape
    each = np.arange(parts)
    net, radius = np.zeros((parts, min(most, n)), np.int64), np.zeros((parts, min(most, n)))
    nearest, owner = np.full((parts, n), np.inf), np.zeros((parts, n), np.int64)
    for k in range(net.shape[1]):
        far = nearest.argmax(1) if k else np.zeros(parts, np.int64)
        net[:, k], radius[:, k] = far, np.sqrt(nearest[each, far])
        distance = ((points - points[each, far][:, None]) ** 2).sum(2)
        closer = distance < nearest
        owner[closer] = k
        nearest[closer] = distance[closer]
        if not nearest.any():
            return net[:, : k + 1], radius[:, : k + 1], owner
    return net, radius, owner


class Tree:
    """The cover tree of one part of some rows: levels of nodes, each a run of the points in ``order``."""

    def __init__(self, points: np.ndarray, net: np.ndarray, radius: np.ndarray, owner: np.ndarray) -> None:
        used = max(1, int((radius > 0).sum()))  # beyond them all points are net points
        centres = points[net[:used]].astype(np.float64)
        # nets of halving radii: that of a level is the first points of the walk
        top = radius[1] if used > 1 else 0.0
        sizes = sorted({1, used} | {1 + int((radius[1:used] > top / 2**i).sum()) for i in range(LEVELS)})
        above = np.minimum(owner, used - 1)
        ancestors = [above]
        for size in sizes[-2::-1]:  # the nearest point of the coarser net
            far = ((centres[:, None] - centres[None, :size]) ** 2).sum(2).argmin(1)
            above = far[above]
            ancestors.append(above)
        ancestors.reverse()
        self.order = np.lexsort(ancestors[::-1])
        self.points = points[self.order]
        self.levels = []
        for names in ancestors:
            name = names[self.order]
            start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            centre = centres[name[start]]
            size = np.diff(start, append=len(name))
            distance = np.sqrt(((self.points - np.repeat(centre, size, axis=0)) ** 2).sum(1))
            self.levels.append((start, size, centre, np.maximum.reduceat(distance, start), np.add.reduceat(self.points, start, axis=0)))


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry of each point (in the tree's order), numbers and sums by entry, and how many points were compared one by one."""
    n, entries = len(tree.points), len(book)
    code = np.full(n, -1)
    count, total = np.zeros(entries, np.int64), np.zeros(book.shape, np.int64)
    left = np.ones((1, entries), bool)  # entries that may be nearest to a point of a node, by node
    open_points = np.ones(n, bool)
    places = np.zeros(1, np.int64)  # begins of the nodes that stay open
    for start, size, centre, radius, sums in tree.levels:
        live = np.flatnonzero(open_points[start])
        if not len(live):
            break
        left = left[np.searchsorted(places, start[live], side="right") - 1]
        distance = np.sqrt(((centre[live][:, None] - book[None]) ** 2).sum(2, dtype=np.float64))
        distance[~left] = np.inf
        nearest = distance.argmin(1)
        bound = distance[np.arange(len(live)), nearest] + 2 * radius[live]
        left = distance <= (bound * (1 + 1e-9) + 1e-9)[:, None]
        sure = left.sum(1) == 1
        done, entry = live[sure], nearest[sure]
        np.add.at(count, entry, size[done])
        np.add.at(total, entry, sums[done])
        which = np.repeat(start[done] - np.cumsum(size[done]) + size[done], size[done]) + np.arange(size[done].sum())
        code[which] = np.repeat(entry, size[done])
        open_points[which] = False
        left, places = left[~sure], start[live[~sure]]
    rest = np.flatnonzero(open_points)
    if len(rest):
        group = np.searchsorted(places, rest, side="right") - 1
        best = np.full(len(rest), np.iinfo(np.int64).max)
        for e in range(entries):  # in whole numbers; an equal distance leaves the lower index
            some = np.flatnonzero(left[group, e])
            distance = ((tree.points[rest[some]] - book[e]) ** 2).sum(1)
            closer = distance < best[some]
            best[some[closer]] = distance[closer]
            code[rest[some[closer]]] = e
        np.add.at(count, code[rest], 1)
        np.add.at(total, code[rest], tree.points[rest])
    return code, count, total, len(rest)


def _packed(ints: np.ndarray, parts: int) -> bytes:
    """The trees of some rows, as bytes."""
    points = np.ascontiguousarray(ints.reshape(len(ints), parts, -1).transpose(1, 0, 2))
    net, radius, owner = farthest_first(points.astype(np.float64), NET)
    held = {}
    for p in range(parts):
        tree = Tree(points[p], net[p], radius[p], owner[p])
        held[f"o{p}"], held[f"p{p}"] = tree.order.astype(np.int32), tree.points.astype(np.int32)
        for i, level in enumerate(tree.levels):
            for j, x in enumerate(level):
                held[f"{p}.{i}.{j}"] = x.astype(np.int32) if j < 2 else x
    out = io.BytesIO()
    np.savez(out, **held)
    return out.getvalue()


def _unpacked(data: bytes, parts: int) -> list[Tree]:
    made = []
    with np.load(io.BytesIO(data)) as held:
        for p in range(parts):
            tree = Tree.__new__(Tree)
            tree.order, tree.points, tree.levels = held[f"o{p}"], held[f"p{p}"].astype(np.int64), []
            while f"{p}.{len(tree.levels)}.0" in held:
                tree.levels.append(tuple(held[f"{p}.{len(tree.levels)}.{j}"] for j in range(5)))
            made.append(tree)
    return made


def whole_parts(vectors: DataFrame, key: str, embedding: str, label: str, scale: int) -> DataFrame:
    """``key, label, ints`` of the rows that take part."""
    doubles = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), doubles.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where((F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    number = lambda x: F.when(F.abs(F.lit(scale) * x) <= LARGEST, F.floor(F.lit(scale) * x)).otherwise(F.raise_error(F.lit("a scaled component is beyond 2^26"))).cast("int")
    return rows.select("key", "label", F.transform("v", number).alias("ints"))


def trees(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """``keys, labels, trees``: some rows of a task at a time, and their cover trees."""
    kinds = dict(rows.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if n + len(part) > ROWS:
                    yield made(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ints = np.asarray(table["ints"].combine_chunks().flatten(), np.int64).reshape(len(table), -1)
        names = [pa.ListArray.from_arrays([0, len(table)], pa.concat_arrays(table[c].chunks)) for c in ("key", "label")]
        return pa.RecordBatch.from_arrays([*names, pa.array([_packed(ints, parts)], pa.binary())], names=["keys", "labels", "trees"])

    return rows.mapInArrow(build, f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, trees binary")


def lloyd_round(forest: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry: arrays by part, entry and component."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for data in batch["trees"]:
                for p, tree in enumerate(_unpacked(data, parts)):
                    _, count, total, _ = assign(tree, books[p])
                    out[p, :, 0] += count
                    out[p, :, 1:] += total
        at = np.flatnonzero(out)
        yield pd.DataFrame({"at": at, "x": out.ravel()[at]})

    sums = forest.select("trees").mapInPandas(summed, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect()  # a row for each number of the codebooks
    out = np.zeros(books.size + parts * entries, np.int64)
    for r in sums:
        out[r["at"]] = r["x"]
    out = out.reshape(parts, entries, width + 1)
    return out[..., 0], out[..., 1:]


def coded(forest: DataFrame, books: np.ndarray, key: str, label: str) -> DataFrame:
    """``key, label, code, error`` of each row."""
    parts = len(books)
    kinds = {c: t.removeprefix("array<").removesuffix(">") for c, t in forest.dtypes}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, labels, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                codes, error = np.zeros((len(keys), parts), np.uint8 if books.shape[1] <= 256 else ">u2"), np.zeros(len(keys), np.int64)
                for p, tree in enumerate(_unpacked(data.as_py(), parts)):
                    code, *_ = assign(tree, books[p])
                    codes[tree.order, p] = code
                    error[tree.order] += ((tree.points - books[p][code]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([keys.values, labels.values, pa.array([x.tobytes().hex() for x in codes]), pa.array(error)], names=["key", "label", "code", "error"])

    made = forest.mapInArrow(rows, f"key {kinds['keys']}, label {kinds['labels']}, code string, error long")
    return made.withColumnsRenamed({"key": key, "label": label})


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows of ``coded``, and the codebooks by part, entry and component."""
    rows = whole_parts(vectors, key, embedding, label, scale)
    first = rows.orderBy(F.asc_nulls_last("key"), "ints").limit(entries).collect()  # the codebooks' beginning
    known = rows.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most")).first()
    width = known["most"] or parts
    if known["least"] != known["most"] or width % parts:
        raise ValueError(f"vectors have from {known['least']} to {known['most']} components, not one multiple of {parts}")
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    forest = cut(trees(rows, parts))
    for _ in range(rounds if len(first) else 0):
        count, total = lloyd_round(forest, books)
        books = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], books)
    return coded(forest, books, key, label), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``label_error``: the errors of all rows of the same label; nulls are one label."""
    rows = cut(rows)
    sums = cut(rows.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error")))
    return rows.join(small(sums), F.col(f"`{label}`").eqNullSafe(F.col("_label"))).drop("_label")
