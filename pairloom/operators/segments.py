"""Matched ranges: islands, coverage, consolidation of chunk matches, alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(ranges: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges merged where they overlap or touch: one row per island of each key."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where(F.col(end) >= F.col(start)).withColumn("new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def union_length(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Characters that a key's half-open ranges cover, and how many islands they are."""
    made = islands(ranges, key)
    return made.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("islands"))


def coverage(covered: Column, length: Column) -> Column:
    """Share of a text that is covered, at most 1; 0 for an empty text."""
    return F.when(length > 0, F.least(F.lit(1.0), covered / length)).otherwise(0.0)


def consolidate(matches: DataFrame, key: list[str]) -> DataFrame:
    """Chunk matches of a pair joined to segments.

    In order of source, then target, a match joins the last segment if it overlaps
    or touches it on both sides and does not go back in the target; else it starts
    a segment. A pair's matches are few, so a group is small.
    """
    schema = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in key) + ", source_start long, source_end long, target_start long, target_end long, score double, matches long"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for m in group.sort_values(["source_start", "target_start", "source_end", "target_end"]).itertuples(index=False):
            last = rows[-1] if rows else None
            if last and m.source_start <= last["source_end"] and last["source_start"] <= m.source_end and m.target_start <= last["target_end"] and m.target_start >= last["target_start"]:
                last["source_end"], last["target_end"] = max(last["source_end"], m.source_end), max(last["target_end"], m.target_end)
                last["score"], last["matches"] = max(last["score"], m.score), last["matches"] + 1
            else:
                rows.append({c: getattr(m, c) for c in (*key, "source_start", "source_end", "target_start", "target_end", "score")} | {"matches": 1})
        return pd.DataFrame(rows)

    return matches.groupBy(*key).applyInPandas(join, schema)


def chunk_offsets(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """Start and end of each chunk if a document's chunks follow each other."""
    before = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return chunks.withColumn("start", start).withColumn("end", start + F.length(text))
