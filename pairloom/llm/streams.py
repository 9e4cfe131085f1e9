"""Groups of sorted rows inside a task, without a data frame for each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, about; rows that are broadcast at most, of a few numbers each.
BATCH_BYTES, SMALL_ROWS = 4 << 20, 500_000


def bounded_batches(spark: SparkSession) -> None:
    """Keeps an Arrow batch of long texts within a worker's memory, by its bytes.

    The bound stays set in the session; how many rows a batch may have is not changed.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def small(rows: DataFrame) -> DataFrame:
    """``rows``, which are cut, to be broadcast if they are few; else joined as Spark sees fit."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def tasks(rows: DataFrame) -> int:
    """Tasks for work that is large for the size of its rows, which Spark would merge."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, and where in them each group begins (and the end).

    Rows must come sorted by ``key``. The last group of a batch waits for the next
    batch, so at most a batch and one group are held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and not _same(held[-1], batch, key):
            yield _split(held, key)
            held = []
        last = batch[key].iloc[-1]
        different = np.flatnonzero((batch[key] != last).any(axis=1).to_numpy())
        until = int(different[-1]) + 1 if len(different) else 0
        if until:
            yield _split([*held, batch.iloc[:until]], key)
            held = [batch.iloc[until:]]
        else:
            held.append(batch)
    if held:
        yield _split(held, key)


def _same(a: pd.DataFrame, b: pd.DataFrame, key: list[str]) -> bool:
    return bool((a[key].iloc[-1].to_numpy() == b[key].iloc[0].to_numpy()).all())


def _split(parts: list[pd.DataFrame], key: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    frame = parts[0] if len(parts) == 1 else pd.concat(parts)
    frame = frame.reset_index(drop=True)
    values = frame[key]
    starts = np.flatnonzero((values != values.shift()).any(axis=1).to_numpy())
    return frame, np.append(starts, len(frame))


class Forest:
    """Union-find over the rows of a group."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        """Whether that joined two trees."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        """Root of every row."""
        parent = self.parent
        while True:
            above = parent[parent]
            if (above == parent).all():
                self.parent = parent
                return parent
            parent = above
