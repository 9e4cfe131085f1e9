"""Greedy windows: each begins with the first event that the one before does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import cut


def next_starts(events: DataFrame, key: str, at: str, length: float) -> DataFrame:
    """``key, at, next``: the first time of the same key that is ``length`` or more after each distinct time, null if there is none.

    Times are dealt to cells of ``length``, so what is sought stands in the next cell,
    behind the same offset, or else first in a later cell. A sort holds two cells at
    most, never all events of a key.
    """
    times = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("double").alias("at")).distinct()
    times = cut(times.withColumn("cell", F.floor(F.col("at") / length)))
    asks = times.select("key", (F.col("cell") + 1).alias("cell"), (F.col("at") + length).alias("t"), "at", F.lit(None).cast("double").alias("held"))
    rows = asks.unionByName(times.select("key", "cell", F.col("at").alias("t"), F.lit(None).cast("double").alias("at"), F.col("at").alias("held")))
    after = Window.partitionBy("key", "cell").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = rows.withColumn("found", F.min("held").over(after)).where("at IS NOT NULL").select("key", "at", "cell", "found")
    firsts = times.groupBy("key", "cell").agg(F.min("at").alias("first"))  # a row for each cell that has events
    cells = firsts.select("key", "cell", "first").unionByName(near.where("found IS NULL").select("key", "cell", F.lit(None).cast("double").alias("first")).distinct())
    later = Window.partitionBy("key").orderBy("cell").rangeBetween(1, Window.unboundedFollowing)
    behind = cells.withColumn("later", F.min("first").over(later)).groupBy("key", "cell").agg(F.min("later").alias("later"))
    return near.join(behind, ["key", "cell"], "left").select("key", "at", F.coalesce("found", "later").alias("next"))


def greedy_windows(events: DataFrame, key: str, at: str, length: float) -> DataFrame:
    """``key, start, end, events``: windows of each key's events; one begins with the key's first event, or the first that is ``length`` or more after the window before began.

    Every time points to the one that would begin the next window. Pointers are
    doubled, and each doubling marks all beginnings twice as far, so there are as
    many rounds as the logarithm of the largest number of windows. Events with a null
    key or time are ignored; ``end`` is a window's last event.
    """
    jumps = cut(next_starts(events, key, at, length))
    begins = cut(jumps.groupBy("key").agg(F.min("at").alias("at")))
    jumps = cut(jumps.where("next IS NOT NULL"))
    while not jumps.isEmpty():
        reached = begins.join(jumps, ["key", "at"]).select("key", F.col("next").alias("at"))
        begins = cut(begins.unionByName(reached).distinct())
        onward = jumps.select("key", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = cut(jumps.join(onward, ["key", "next"]).select("key", "at", F.col("beyond").alias("next")))
    times = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.col(at).cast("double").alias("at")).agg(F.count("*").alias("n"))
    # the window of a time is the last that begins in its cell up to it, or else the last of an earlier cell
    marked = cut(times.join(begins.withColumn("begin", F.lit(True)), ["key", "at"], "left").withColumn("cell", F.floor(F.col("at") / length)))
    upto = Window.partitionBy("key", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max(F.when(F.col("begin"), F.col("at"))).over(upto)
    last = marked.groupBy("key", "cell").agg(F.max(F.when(F.col("begin"), F.col("at"))).alias("last"))  # a row for each cell that has events
    before = last.withColumn("before", F.max("last").over(Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    placed = marked.withColumn("own", own).join(before.select("key", "cell", "before"), ["key", "cell"]).withColumn("start", F.coalesce("own", "before"))
    return placed.groupBy(F.col("key").alias(key), "start").agg(F.max("at").alias("end"), F.sum("n").alias("events"))
