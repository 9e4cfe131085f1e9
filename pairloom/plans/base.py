"""Incidents, documents and series that the given tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.severity import severity
from pairloom.runtime import table


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as incidents: a part matches a supplier, the discount is the score."""
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "False Positive").when(F.col("l_returnflag") == "R", "Confirmed").otherwise("Pending")
    found = rows.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("doc_a"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("doc_b"),
        F.least(F.lit(1.0), F.col("l_discount") * 10).alias("score"),
        status.alias("status"),
        F.col("l_shipdate").alias("flagged_at"),
    )
    return found.withColumn("severity", severity("score"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as documents."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    p = part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("filename"),
        (F.col("p_size") % 10 == 0).alias("is_deleted"),
        F.replace("p_type", F.lit(" "), F.lit(",")).alias("tags"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("owner"),
    )
    s = supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("filename"),
        (F.col("s_nationkey") == 0).alias("is_deleted"),
        F.lit("").alias("tags"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("owner"),
    )
    return p.unionByName(s)


#: The same in SQL, to put before a query.
WITH = """
inc0 AS (
  SELECT 'p' || l_partkey AS doc_a, 's' || l_suppkey AS doc_b, least(1.0, l_discount * 10) AS score,
    CASE l_returnflag WHEN 'A' THEN 'False Positive' WHEN 'R' THEN 'Confirmed' ELSE 'Pending' END AS status, l_shipdate AS flagged_at
  FROM lineitem
), inc AS (
  SELECT *, CASE WHEN score >= 0.9 THEN 'High' WHEN score >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity,
    'INC-' || upper(substr(sha256(least(doc_a, doc_b) || '||' || greatest(doc_a, doc_b)), 1, 12)) AS incident_id FROM inc0
), cat AS (
  SELECT 'p' || p_partkey AS filename, p_size % 10 = 0 AS is_deleted, replace(p_type, ' ', ',') AS tags, p_name AS title, p_brand AS owner FROM part
  UNION ALL SELECT 's' || s_suppkey, s_nationkey = 0, '', s_name, 'nation' || s_nationkey FROM supplier
), gone AS (SELECT filename FROM cat WHERE is_deleted),
vis AS (SELECT * FROM inc WHERE doc_a NOT IN (SELECT filename FROM gone) AND doc_b NOT IN (SELECT filename FROM gone)),
sides AS (
  SELECT doc_a AS doc, doc_b AS other, score, severity, status, flagged_at FROM inc
  UNION ALL SELECT doc_b, doc_a, score, severity, status, flagged_at FROM inc
)
"""
