"""Streams of events and documents: windows with late data, rescans, spikes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.operators.incidents import canonical


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time."""
    made = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    return made.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def replay(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table, one file or a folder of any number, as a stream in one trigger, so that no order of files makes a row late."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a plain path has to be a folder
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    made = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    made = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, to Parquet, exactly once; then the query ends."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def rescan(stream: DataFrame, score: Any, stored: str, checkpoint: str) -> None:
    """Scores each micro-batch and adds pairs that no stored incident has.

    ``score`` makes ``doc_a, doc_b, score`` of a batch. A batch writes to a folder
    of its own number, so a repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        found = canonical(score(batch))
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(stored).where(F.col("batch") != number).select("incident_id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = found.select("incident_id").limit(0)
        new = found.join(old, "incident_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{stored}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spikes(events: DataFrame, folder: str, checkpoint: str, size: int = 60, least: int = 10, threshold: float = 3.0) -> None:
    """Values over ``threshold`` deviations from the mean of a user's last ``size``, to ``folder``/out.

    A micro-batch is judged in the order of ``ts, event_id`` by a window, which
    spills; the last rows of each user go on to the next one through
    ``folder``/last. A repeated batch replaces itself.
    """
    order = ["batch", "ts", "event_id"]

    def judge(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "ts", "event_id", "value", F.lit(number).cast("long").alias("batch"))
        if number:
            rows = batch.sparkSession.read.schema(rows.schema).parquet(f"{folder}/last/{number - 1}").unionByName(rows)
        last = Window.partitionBy("user_id").orderBy(*order).rowsBetween(1 - size, 0)
        mean, sd = F.avg("value").over(last), F.stddev_pop("value").over(last)
        judged = rows.withColumns({"n": F.count("value").over(last), "sd": sd, "z": F.when(sd > 0, (F.col("value") - mean) / sd)})
        found = judged.where((F.col("batch") == number) & (F.col("n") >= least) & (F.abs("z") > threshold))
        found.select("user_id", "event_id", "value", "z").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        newest = F.row_number().over(Window.partitionBy("user_id").orderBy(*map(F.desc, order)))
        rows.withColumn("newest", newest).where(F.col("newest") < size).drop("newest").write.mode("overwrite").parquet(f"{folder}/last/{number}")

    events.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
