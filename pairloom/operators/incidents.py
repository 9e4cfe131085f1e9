"""Incidents: pairs of documents that were flagged, their pages, upserts and counts.

An incident table has ``doc_a, doc_b, score, severity, status, flagged_at``; a
document table has ``filename, is_deleted, tags, title, owner``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.severity import severity

SORTS = ("incident_id", "doc_a", "doc_b", "score", "severity", "status", "flagged_at")


def incident_id(a: Column, b: Column) -> Column:
    """INC- and 12 digits of the hash of the unordered pair."""
    pair = F.concat(F.least(a, b), F.lit("||"), F.greatest(a, b))
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.sha2(pair, 256), 1, 12)))


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs with ``doc_a`` below ``doc_b`` and their id; pairs of one document go."""
    low, high = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
    return pairs.where("doc_a <> doc_b").withColumns({"doc_a": low, "doc_b": high}).withColumn("incident_id", incident_id(F.col("doc_a"), F.col("doc_b")))


def best_of_pair(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair: its best score, first and last flag, and number of flags."""
    grouped = canonical(pairs).groupBy("incident_id", "doc_a", "doc_b")
    made = grouped.agg(F.max("score").alias("score"), F.min("flagged_at").alias("first_seen"), F.max("flagged_at").alias("last_seen"), F.count("*").alias("times_flagged"))
    return made.withColumn("severity", severity("score"))


def visible(incidents: DataFrame, documents: DataFrame) -> DataFrame:
    """Incidents of which neither document is deleted; a document without a row counts as there."""
    gone = documents.where("is_deleted").select("filename")
    a = incidents.join(gone, F.col("doc_a") == F.col("filename"), "left_anti")
    return a.join(gone, F.col("doc_b") == F.col("filename"), "left_anti")


def page(rows: DataFrame, number: int = 1, size: int = 20, sort: str = "flagged_at", descending: bool = True, wanted: str | None = None, search: str | None = None) -> DataFrame:
    """A page of incidents with the total of rows and pages; unknown sorts give the default."""
    sort = sort if sort in SORTS else "flagged_at"
    if wanted:
        rows = rows.where(F.col("severity") == wanted)
    if search:
        rows = rows.where(F.contains("doc_a", F.lit(search)) | F.contains("doc_b", F.lit(search)))
    total = rows.agg(F.count("*").alias("total"))
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    shown = rows.orderBy(key, "incident_id").offset((max(1, number) - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))  # total is one row


def upsert(stored: DataFrame, flags: DataFrame, now: datetime) -> DataFrame:
    """Stored incidents after new flags.

    A known pair keeps its first date, threshold and review status; score,
    severity and last date are new and its count rises. A new pair starts pending.
    """
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in ("incident_id", "doc_a", "doc_b", "score", "severity", "status", "first_seen", "last_seen", "threshold", "times_flagged")])
    new = flags.groupBy("incident_id").agg(F.max_by("doc_a", "score").alias("doc_a"), F.max_by("doc_b", "score").alias("doc_b"), F.max("score").alias("score"), F.max("threshold").alias("threshold"))
    met = old.join(new, F.col("old_incident_id") == F.col("incident_id"), "full")
    again, at = F.col("incident_id").isNotNull(), F.lit(now).cast("timestamp")
    return met.select(
        F.coalesce("old_incident_id", "incident_id").alias("incident_id"),
        F.coalesce("old_doc_a", "doc_a").alias("doc_a"),
        F.coalesce("old_doc_b", "doc_b").alias("doc_b"),
        F.coalesce("score", "old_score").alias("score"),
        F.when(again, severity("score")).otherwise(F.col("old_severity")).alias("severity"),
        F.coalesce("old_status", F.lit("Pending")).alias("status"),
        F.coalesce("old_first_seen", at).alias("first_seen"),
        F.when(again, at).otherwise(F.col("old_last_seen")).alias("last_seen"),
        F.coalesce("old_threshold", "threshold").alias("threshold"),
        (F.coalesce("old_times_flagged", F.lit(0)) + again.cast("long")).alias("times_flagged"),
    )


def split_archive(incidents: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Incidents kept, and those flagged before the cutoff."""
    old = F.col("flagged_at") < F.lit(cutoff)
    return incidents.where(~old | F.col("flagged_at").isNull()), incidents.where(old)


def new_pairs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found pairs that no stored incident has."""
    return canonical(found).join(stored.select("incident_id"), "incident_id", "left_anti")


def without_false_positives(incidents: DataFrame) -> DataFrame:
    """Incidents of pairs that were never marked as a false positive."""
    marked = incidents.where("status = 'False Positive'").select("incident_id").distinct()
    return incidents.join(marked, "incident_id", "left_anti")


def both_sides(incidents: DataFrame) -> DataFrame:
    """A row for each document of each incident."""
    other = ("score", "severity", "status", "flagged_at")
    a = incidents.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other"), *other)
    return a.unionByName(incidents.select(F.col("doc_b").alias("doc"), F.col("doc_a").alias("other"), *other))


def most_flagged(incidents: DataFrame, limit: int = 10) -> DataFrame:
    """Documents with most incidents, on either side; ties by name."""
    counts = both_sides(incidents).groupBy("doc").agg(F.count("*").alias("incident_count"))
    return counts.orderBy(F.desc("incident_count"), "doc").limit(limit)


def risk_profiles(incidents: DataFrame, top: int = 10) -> DataFrame:
    """Incident count, mean and highest score, severity and last flag by document."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    sides = both_sides(incidents).where("doc <> ''").withColumn("score", score)
    made = sides.groupBy("doc").agg(F.count("*").alias("incident_count"), F.round(F.avg("score"), 4).alias("avg_similarity"), F.max("score").alias("most"), F.max("flagged_at").alias("last_flagged"))
    made = made.select("doc", "incident_count", "avg_similarity", F.round("most", 4).alias("max_similarity"), severity("most").alias("severity"), "last_flagged")
    return made.orderBy(F.desc("incident_count"), F.desc("max_similarity"), "doc").limit(top)


def top_offenders(incidents: DataFrame, top: int = 10) -> DataFrame:
    """Documents (first side) with most incidents and whom they match."""
    made = incidents.groupBy("doc_a").agg(
        F.count("*").alias("incident_count"),
        F.round(F.avg("score"), 4).alias("avg_similarity"),
        F.round(F.max("score"), 4).alias("max_similarity"),
        F.min("flagged_at").alias("first_detected"),
        F.max("flagged_at").alias("last_detected"),
        F.countDistinct("doc_b").alias("unique_matchees"),
    )
    return made.orderBy(F.desc("incident_count"), F.desc("max_similarity"), "doc_a").limit(top)


def repeat_rate(incidents: DataFrame) -> DataFrame:
    """Share of documents with two incidents or more; 0 without incidents."""
    per = incidents.groupBy("doc_a").count()
    return per.agg(F.coalesce(F.round(F.avg((F.col("count") >= 2).cast("double")), 4), F.lit(0.0)).alias("repeat_rate"))


def statistics(incidents: DataFrame, documents: DataFrame) -> DataFrame:
    """Total of visible incidents beside severity counts of all."""
    shown = visible(incidents, documents).agg(F.count("*").alias("total_visible"))
    counts = incidents.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("High", "Medium", "Low")], F.count_if(F.col("status") == "Pending").alias("pending"))
    return shown.crossJoin(F.broadcast(counts))  # one row each


def severity_buckets(incidents: DataFrame) -> DataFrame:
    """Count, share and scores of each severity that occurs."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    made = incidents.withColumn("score", score).groupBy(severity("score").alias("severity"))
    made = made.agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 2)  # three rows at most
    return made.withColumn("percentage", share)


def threshold_sensitivity(incidents: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """How many incidents reach each threshold, in one pass over the scores."""
    grid = thresholds or [round(0.30 + i * 0.05, 2) for i in range(14)]
    counts = incidents.agg(F.count("score").alias("n"), *[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("incident_count")) for i, t in enumerate(grid)])
    return counts.select("n", F.explode(pairs).alias("x")).select(
        "x.threshold", "x.incident_count", F.when(F.col("n") > 0, F.round(F.col("x.incident_count") / F.col("n") * 100, 2)).otherwise(0.0).alias("pct_of_total")
    )


def watched(pairs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Scan pairs that watch entries ask for: a document on either side, a pair on both.

    ``watchlist`` has ``entry_id, kind, target, other, min_score``; kind is document or pair.
    """
    single = watchlist.where("kind = 'document'")
    hits = [pairs.join(single, (F.col(side) == F.col("target")) & (F.col("score") >= F.col("min_score"))) for side in ("doc_a", "doc_b")]
    double = watchlist.where("kind = 'pair'").withColumns({"low": F.least("target", "other"), "high": F.greatest("target", "other")})
    both = (F.least("doc_a", "doc_b") == F.col("low")) & (F.greatest("doc_a", "doc_b") == F.col("high")) & (F.col("score") >= F.col("min_score"))
    columns = ["entry_id", "doc_a", "doc_b", "score"]
    return hits[0].select(columns).union(hits[1].select(columns)).union(pairs.join(double, both).select(columns)).distinct()
