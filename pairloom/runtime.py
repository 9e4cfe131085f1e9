"""Session factory, table loader and the one way in which jobs cut lineage."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(master)
        .appName("pairloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed (else ``--py-files``)."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    It is read from the session. Only a local master may fall back to a
    temporary folder; on a cluster an unset folder is an error, because what one
    machine writes to its own disk the others can't read.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-pairloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


#: Whether the shuffle files of a query go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Used where a result is read several times or a loop would grow the plan. The
    files survive lost executors; Spark removes them with the DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on. What was shuffled for
    ``df`` is not read again, so those files go at once and not whenever the driver
    collects its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, since a plan keeps the setting it was made with
    finally:
        spark.conf.set(CLEANED, before)


#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers end at ``BATCH_BYTES``, so that long texts fit; the bound stays set in the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
