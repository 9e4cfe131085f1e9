"""Queries on incidents: pages, visibility, upserts, counts and profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import incidents as op
from pairloom.operators.filters import has_tag, keyset_page, metadata_filter
from pairloom.plans.base import WITH, catalogue, incidents

NOW, CUTOFF = datetime(2003, 1, 1), datetime(1997, 1, 1)


def incident_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per unordered pair, its best score, first and last flag."""
    return op.best_of_pair(incidents(spark, d))


def incident_page(spark: SparkSession, d: str) -> DataFrame:
    pairs = op.best_of_pair(incidents(spark, d)).withColumns({"status": F.lit("Pending"), "flagged_at": F.col("last_seen")})
    shown = op.page(op.visible(pairs, catalogue(spark, d)), 2, 25, "score", True, "High", "p1")
    return shown.select("incident_id", "doc_a", "doc_b", "score", "severity", "total", "pages")


def incident_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    pairs = op.best_of_pair(incidents(spark, d)).select("incident_id", "score")
    return keyset_page(pairs, "incident_id", 40, "INC-8")


def incident_visible_count(spark: SparkSession, d: str) -> DataFrame:
    return op.visible(incidents(spark, d), catalogue(spark, d)).agg(F.count("*").alias("visible"))


def incident_statistics(spark: SparkSession, d: str) -> DataFrame:
    return op.statistics(incidents(spark, d), catalogue(spark, d))


def incident_by_date(spark: SparkSession, d: str) -> DataFrame:
    shown = op.visible(incidents(spark, d), catalogue(spark, d))
    return shown.groupBy(F.date_format("flagged_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("incident_count"))


def incident_date_range(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d).where(F.col("flagged_at").between(F.lit("1996-03-01").cast("timestamp"), F.lit("1996-03-31").cast("timestamp")))
    return rows.select("doc_a", "doc_b", "score", "flagged_at")


def incident_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which either document belongs to an owner, each once."""
    own = catalogue(spark, d).where(F.col("owner") == "Brand#12").select("filename")
    pairs = incidents(spark, d).select("doc_a", "doc_b")
    a = pairs.join(own, F.col("doc_a") == F.col("filename"), "left_semi")
    return a.union(pairs.join(own, F.col("doc_b") == F.col("filename"), "left_semi")).distinct()


def incident_high_severity_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d).where("severity = 'High'")
    last = rows.agg(F.max("flagged_at").alias("last"))
    recent = rows.crossJoin(F.broadcast(last)).where(F.col("flagged_at") >= F.col("last") - F.expr("INTERVAL 30 DAY"))
    return recent.groupBy(F.date_format("flagged_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("high"))


def incident_most_flagged(spark: SparkSession, d: str) -> DataFrame:
    return op.most_flagged(op.visible(incidents(spark, d), catalogue(spark, d)), 15)


def incident_risk_profiles(spark: SparkSession, d: str) -> DataFrame:
    return op.risk_profiles(incidents(spark, d), 20)


def incident_top_offenders(spark: SparkSession, d: str) -> DataFrame:
    return op.top_offenders(incidents(spark, d), 20)


def incident_repeat_rate(spark: SparkSession, d: str) -> DataFrame:
    return op.repeat_rate(incidents(spark, d))


def incident_severity_buckets(spark: SparkSession, d: str) -> DataFrame:
    return op.severity_buckets(incidents(spark, d))


def incident_threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return op.threshold_sensitivity(incidents(spark, d))


def incident_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Incidents up to 1997 are stored; those after come as new flags."""
    rows, later = incidents(spark, d), F.lit("1997-01-01").cast("timestamp")
    stored = op.best_of_pair(rows.where(F.col("flagged_at") < later)).withColumns({"status": F.lit("Confirmed"), "threshold": F.lit(0.59)})
    flags = op.canonical(rows.where((F.col("flagged_at") >= later) & (F.col("score") >= 0.75))).withColumn("threshold", F.lit(0.75))
    return op.upsert(stored, flags, NOW)


def incident_archive(spark: SparkSession, d: str) -> DataFrame:
    kept, old = op.split_archive(incidents(spark, d), CUTOFF)
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).union(old.agg(F.lit("archived"), F.count("*")))


def incident_new_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows, later = incidents(spark, d), F.lit("1997-01-01").cast("timestamp")
    stored = op.canonical(rows.where(F.col("flagged_at") < later))
    return op.new_pairs(rows.where(F.col("flagged_at") >= later), stored).select("incident_id", "doc_a", "doc_b").distinct()


def incident_no_false_positives(spark: SparkSession, d: str) -> DataFrame:
    return op.without_false_positives(op.canonical(incidents(spark, d))).agg(F.count("*").alias("n"), F.countDistinct("incident_id").alias("pairs"))


def incident_watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth supplier is watched alone, every pair of an early part with high score as a pair."""
    rows = op.best_of_pair(incidents(spark, d))
    docs = catalogue(spark, d).where(F.col("filename").startswith("s") & (F.substring("filename", 2, 9).cast("long") % 100 == 0))
    single = docs.select(F.concat(F.lit("d-"), F.col("filename")).alias("entry_id"), F.lit("document").alias("kind"), F.col("filename").alias("target"), F.lit(None).cast("string").alias("other"), F.lit(0.9).alias("min_score"))
    double = rows.where("doc_a LIKE 'p1%'").select(F.concat(F.lit("w-"), F.col("incident_id")).alias("entry_id"), F.lit("pair").alias("kind"), F.col("doc_b").alias("target"), F.col("doc_a").alias("other"), F.lit(0.95).alias("min_score"))
    return op.watched(rows.select("doc_a", "doc_b", "score"), single.unionByName(double))


def document_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = catalogue(spark, d).where("NOT is_deleted")
    return docs.select(F.explode(F.split("tags", ",")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("documents"))


def document_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d).where(has_tag("tags", "promo") & ~F.col("is_deleted")).select("filename", "title")


def document_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = metadata_filter([("owner", "in", ["Brand#11", "Brand#22"]), ("tags", "contains", "larg"), ("title", "ne", "x")])
    return catalogue(spark, d).where(wanted).select("filename", "owner")


QUERIES = {f.__name__: f for f in (
    incident_pairs, incident_page, incident_keyset_page, incident_visible_count, incident_statistics, incident_by_date, incident_date_range,
    incident_by_owner, incident_high_severity_trend, incident_most_flagged, incident_risk_profiles, incident_top_offenders, incident_repeat_rate,
    incident_severity_buckets, incident_threshold_sensitivity, incident_upsert, incident_archive, incident_new_pairs, incident_no_false_positives,
    incident_watchlist, document_tags, document_tag_filter, document_metadata_filter,
)}

PAIRS = """pairs AS (
  SELECT incident_id, doc_a, doc_b, max(score) AS score, min(flagged_at) AS first_seen, max(flagged_at) AS last_seen, count(*) AS times_flagged
  FROM inc GROUP BY ALL
), rated AS (SELECT *, CASE WHEN score >= 0.9 THEN 'High' WHEN score >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity FROM pairs)"""

SQL = {
    "incident_pairs": f"WITH {WITH}, {PAIRS} SELECT * FROM rated",
    "incident_page": f"""WITH {WITH}, {PAIRS}, f AS (
        SELECT * FROM rated WHERE severity = 'High' AND (contains(doc_a, 'p1') OR contains(doc_b, 'p1'))
          AND doc_a NOT IN (SELECT filename FROM gone) AND doc_b NOT IN (SELECT filename FROM gone))
        SELECT incident_id, doc_a, doc_b, score, severity, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 25.0) AS BIGINT) AS pages
        FROM f ORDER BY score DESC, incident_id LIMIT 25 OFFSET 25""",
    "incident_keyset_page": f"WITH {WITH}, {PAIRS} SELECT incident_id, score FROM pairs WHERE incident_id > 'INC-8' ORDER BY incident_id LIMIT 41",
    "incident_visible_count": f"WITH {WITH} SELECT count(*) AS visible FROM vis",
    "incident_statistics": f"""WITH {WITH} SELECT (SELECT count(*) FROM vis) AS total_visible, count(*) FILTER (severity = 'High') AS high,
        count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(*) FILTER (status = 'Pending') AS pending FROM inc""",
    "incident_by_date": f"WITH {WITH} SELECT strftime(flagged_at, '%Y-%m-%d') AS day, count(*) AS incident_count FROM vis GROUP BY 1",
    "incident_date_range": f"WITH {WITH} SELECT doc_a, doc_b, score, flagged_at FROM inc WHERE flagged_at BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31'",
    "incident_by_owner": f"""WITH {WITH}, own AS (SELECT filename FROM cat WHERE owner = 'Brand#12')
        SELECT DISTINCT doc_a, doc_b FROM inc WHERE doc_a IN (SELECT filename FROM own) OR doc_b IN (SELECT filename FROM own)""",
    "incident_high_severity_trend": f"""WITH {WITH}, h AS (SELECT * FROM inc WHERE severity = 'High')
        SELECT strftime(flagged_at, '%Y-%m-%d') AS day, count(*) AS high FROM h WHERE flagged_at >= (SELECT max(flagged_at) FROM h) - INTERVAL 30 DAY GROUP BY 1""",
    "incident_most_flagged": f"""WITH {WITH} SELECT doc, count(*) AS incident_count FROM (SELECT doc_a AS doc FROM vis UNION ALL SELECT doc_b FROM vis)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "incident_risk_profiles": f"""WITH {WITH} SELECT doc, count(*) AS incident_count, round(avg(score), 4) AS avg_similarity, round(max(score), 4) AS max_similarity,
        CASE WHEN max(score) >= 0.9 THEN 'High' WHEN max(score) >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity, max(flagged_at) AS last_flagged
        FROM sides GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 20""",
    "incident_top_offenders": f"""WITH {WITH} SELECT doc_a, count(*) AS incident_count, round(avg(score), 4) AS avg_similarity, round(max(score), 4) AS max_similarity,
        min(flagged_at) AS first_detected, max(flagged_at) AS last_detected, count(DISTINCT doc_b) AS unique_matchees
        FROM inc GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 20""",
    "incident_repeat_rate": f"WITH {WITH}, c AS (SELECT count(*) AS n FROM inc GROUP BY doc_a) SELECT round(avg(CASE WHEN n >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS repeat_rate FROM c",
    "incident_severity_buckets": f"""WITH {WITH} SELECT severity, count(*) AS n, round(avg(score), 4) AS avg_score, round(min(score), 4) AS min_score,
        round(max(score), 4) AS max_score, round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 2) AS percentage FROM inc GROUP BY 1""",
    "incident_threshold_sensitivity": f"""WITH {WITH}, g AS (SELECT round(0.30 + i * 0.05, 2)::DOUBLE AS threshold FROM range(14) t(i))
        SELECT threshold, count(*) FILTER (score >= threshold) AS incident_count, round(count(*) FILTER (score >= threshold) / count(*)::DOUBLE * 100, 2) AS pct_of_total
        FROM g, inc GROUP BY 1""",
    "incident_upsert": f"""WITH {WITH}, s AS (
        SELECT incident_id, doc_a, doc_b, max(score) AS score, min(flagged_at) AS first_seen, max(flagged_at) AS last_seen, count(*) AS times_flagged
        FROM inc WHERE flagged_at < TIMESTAMP '1997-01-01' GROUP BY ALL
      ), f AS (SELECT incident_id, doc_a, doc_b, max(score) AS score FROM inc WHERE flagged_at >= TIMESTAMP '1997-01-01' AND score >= 0.75 GROUP BY ALL)
      SELECT coalesce(s.incident_id, f.incident_id) AS incident_id, coalesce(s.doc_a, f.doc_a) AS doc_a, coalesce(s.doc_b, f.doc_b) AS doc_b, coalesce(f.score, s.score) AS score,
        CASE WHEN coalesce(f.score, s.score) >= 0.9 THEN 'High' WHEN coalesce(f.score, s.score) >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity,
        CASE WHEN s.incident_id IS NULL THEN 'Pending' ELSE 'Confirmed' END AS status, coalesce(s.first_seen, TIMESTAMP '2003-01-01') AS first_seen,
        CASE WHEN f.incident_id IS NULL THEN s.last_seen ELSE TIMESTAMP '2003-01-01' END AS last_seen,
        CASE WHEN s.incident_id IS NULL THEN 0.75::DOUBLE ELSE 0.59::DOUBLE END AS threshold,
        coalesce(s.times_flagged, 0) + CASE WHEN f.incident_id IS NULL THEN 0 ELSE 1 END AS times_flagged
      FROM s FULL JOIN f ON s.incident_id = f.incident_id""",
    "incident_archive": f"""WITH {WITH} SELECT CASE WHEN flagged_at < TIMESTAMP '1997-01-01' THEN 'archived' ELSE 'kept' END AS part, count(*) AS n FROM inc GROUP BY 1""",
    "incident_new_pairs": f"""WITH {WITH} SELECT DISTINCT incident_id, doc_a, doc_b FROM inc WHERE flagged_at >= TIMESTAMP '1997-01-01'
        AND incident_id NOT IN (SELECT incident_id FROM inc WHERE flagged_at < TIMESTAMP '1997-01-01')""",
    "incident_no_false_positives": f"""WITH {WITH} SELECT count(*) AS n, count(DISTINCT incident_id) AS pairs FROM inc
        WHERE incident_id NOT IN (SELECT incident_id FROM inc WHERE status = 'False Positive')""",
    "incident_watchlist": f"""WITH {WITH}, {PAIRS}
        SELECT 'd-' || filename AS entry_id, doc_a, doc_b, score FROM cat JOIN pairs ON filename IN (doc_a, doc_b)
        WHERE filename LIKE 's%' AND CAST(substr(filename, 2) AS BIGINT) % 100 = 0 AND score >= 0.9
        UNION SELECT 'w-' || incident_id, doc_a, doc_b, score FROM pairs WHERE doc_a LIKE 'p1%' AND score >= 0.95""",
    "document_tags": f"WITH {WITH}, t AS (SELECT unnest(string_split(tags, ',')) AS tag FROM cat WHERE NOT is_deleted) SELECT tag, count(*) AS documents FROM t WHERE tag <> '' GROUP BY 1",
    "document_tag_filter": f"WITH {WITH} SELECT filename, title FROM cat WHERE list_contains(string_split(tags, ','), 'PROMO') AND NOT is_deleted",
    "document_metadata_filter": f"WITH {WITH} SELECT filename, owner FROM cat WHERE owner IN ('Brand#11', 'Brand#22') AND contains(lower(tags), 'larg') AND title <> 'x'",
}
