"""Running sums over a whole table, within ranges of the key and then over the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import cut


def running(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of ``key``.

    Rows are dealt to ranges of the key and summed within each; only one sum for
    each range meets in one place. Equal keys, and nulls (first), may stand in any
    order among each other. A null value adds nothing.
    """
    spark = rows.sparkSession
    ranged = cut(rows.withColumn("_value", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_value").over(earlier), F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))  # a row for each partition
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = F.broadcast(sums.select("_range", before.alias("_before")))
    return ranged.withColumn(name, own).join(based, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_value", "_before")
