"""Operators on tables of records: class filters, recent repeats, users' rhythms, gates, indexes, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.scoring import grade
from pairloom.operators.severity import HIGH


def within_class(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose two documents are both in ``members`` (its first column)."""
    m = members.select(F.col(members.columns[0]).alias("member")).distinct()
    return pairs.join(m, F.col("doc_a") == F.col("member"), "left_semi").join(m, F.col("doc_b") == F.col("member"), "left_semi")


def emerging(incidents: DataFrame, days: int, least: int = 2) -> DataFrame:
    """Pairs flagged ``least`` times or more in the ``days`` up to the newest incident."""
    newest = incidents.agg(F.max("flagged_at").alias("newest"))
    recent = incidents.crossJoin(F.broadcast(newest)).where(F.col("flagged_at") > F.col("newest") - F.make_dt_interval(F.lit(days)))  # one row
    return recent.groupBy("doc_a", "doc_b").agg(F.count("*").alias("scans"), F.max("score").alias("best")).where(F.col("scans") >= least)


def entropies(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Entropy in bits of ``value`` within each ``key``, from counts."""
    c = F.col("c")
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.round(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), 4).alias(name))


def pauses(rows: DataFrame, key: str, at: str, least: float) -> DataFrame:
    """Gaps of over ``least`` seconds between one key's successive rows: number, mean, longest, and burstiness.

    Burstiness is the population variance of all gaps, in units of 1e8, at most 1.
    """
    second = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    gaps = rows.select(key, (F.lead(second).over(Window.partitionBy(key).orderBy(at)) - second).alias("gap"))
    long = F.when(F.col("gap") > least, F.col("gap"))
    return gaps.groupBy(key).agg(
        F.count(long).alias("pauses"),
        F.round(F.coalesce(F.avg(long), F.lit(0.0)), 3).alias("mean_pause"),
        F.round(F.coalesce(F.max(long), F.lit(0.0)), 3).alias("longest_pause"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.var_pop("gap"), F.lit(0.0)) / 1e8), 4).alias("burstiness"),
    )


def outliers(rows: DataFrame, value: str, least: float) -> DataFrame:
    """Rows whose standard score (population deviation) is ``least`` or more either way; none if all are equal."""
    whole = rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    scored = rows.crossJoin(F.broadcast(whole)).where(F.col("sd") > 0)  # one row
    return scored.withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd")).where(F.abs("z") >= least).drop("mean", "sd")


def reviewer_weight(mae: Column, variance: Column) -> Column:
    """Trust in a reviewer, from 0.1 to 1."""
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 / (1 + mae * 2 + variance * 5))), 4)


def dedup_statistics(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, pairs per document, mean similarity, bands, and the document in most pairs (ties to the smallest)."""
    s = F.col("sim")
    whole = pairs.agg(F.count("*").alias("pairs"), F.round(F.avg("sim"), 6).alias("avg_similarity"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"), F.count_if(s < 0.6).alias("low"))
    ends = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    most = ends.agg(F.max_by("doc", F.struct("n", (-F.col("doc")).alias("d"))).alias("most_duplicated"), F.coalesce(F.max("n"), F.lit(0)).alias("most_pairs"))
    n = documents.agg(F.count("*").alias("documents"))
    made = n.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(most))  # one row each
    return made.withColumn("rate", F.round(F.col("pairs") / F.greatest(F.lit(1), F.col("documents")), 4))


def colluding(clusters: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of ``least`` documents or more; confirmed if their mean similarity is high."""
    return clusters.where(F.col("size") >= least).withColumn("confirmed", F.col("avg_similarity") >= HIGH)


def score_shape(rows: DataFrame, key: str, score: str) -> DataFrame:
    """Kind of each key's scores by variation and skewness, and the shift of a threshold that goes with it."""
    by = rows.groupBy(key).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.skewness(score).alias("skew"))
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0)
    skew = F.when(F.col("n") > 3, F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    kind = F.when(F.col("n") < 2, "unknown").when((cv < 0.15) & (skew > 0.5), "homogeneous").when(cv > 0.4, "heterogeneous").otherwise("mixed")
    made = by.select(key, "n", F.round(cv, 6).alias("cv"), F.round(skew, 4).alias("skewness"), kind.alias("kind"))
    return made.withColumn("shift", F.when(F.col("kind") == "homogeneous", -0.03).when(F.col("kind") == "heterogeneous", 0.03).otherwise(0.0))


def health(dimensions: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted score of dimensions (each from 0 to 100), and the names of those below 25."""
    total = sum((c * w for c, w in dimensions.values()), F.lit(0.0)) / sum(w for _, w in dimensions.values())
    low = F.array_join(F.array_compact(F.array(*[F.when(c < 25, F.lit(n)) for n, (c, _) in dimensions.items()])), ", ")
    return F.round(total, 6), low


def quality_gate(score: Column, critical: Column, least: float = 60.0, least_grade: str = "D") -> dict[str, Column]:
    """Grade, whether a document passes, and why not; critical dimensions are named but don't fail it."""
    # Grades from the worst up.
    order = ("F", "D", "C", "B-", "B", "B+", "A-", "A", "A+")
    mark = grade(score)
    poor = mark.isin(*order[: order.index(least_grade)]) if order.index(least_grade) else F.lit(False)
    why = F.array_compact(F.array(F.when(score < least, F.lit("score")), F.when(poor, F.lit("grade")), F.when(critical != "", F.concat(F.lit("critical: "), critical))))
    return {"grade": mark, "passed": (score >= least) & ~poor, "reason": F.array_join(why, "; ")}


def edit_velocity(minutes: Column, pages: Column) -> dict[str, Column]:
    """Minutes a page, whether they are under 2, and a score that falls with them; null minutes or no pages are normal."""
    rate = F.when(pages > 0, minutes / pages)
    return {"minutes_per_page": F.round(rate, 6), "anomaly": F.coalesce(rate < 2, F.lit(False)), "score": F.round(F.when(rate < 2, F.greatest(F.lit(0.0), rate / 2)).otherwise(1.0), 6)}


def cognitive_load(series: DataFrame, key: str, grade_column: str, index_column: str) -> DataFrame:
    """Sample variances of two readability measures; a key with fewer than three rows has zeros."""
    by = series.groupBy(key).agg(F.count("*").alias("n"), F.var_samp(grade_column).alias("g"), F.var_samp(index_column).alias("c"))
    some = F.col("n") >= 3
    probability = 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("g") / 10)) + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c") / 20))
    zero = lambda c: F.when(some, F.round(c, 4)).otherwise(0.0)
    return by.select(key, zero(F.col("g")).alias("grade_variance"), zero(F.col("c")).alias("index_variance"), (some & (F.col("g") < 2) & (F.col("c") < 5)).alias("synthetic"), zero(probability).alias("probability"))


def without_documents(index: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """An index less the vectors of removed documents."""
    return index.join(removed.select(key).distinct(), key, "left_anti")


def index_check(index: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, dimensions from and to, null or zero vectors; an index is valid if all agree and none is bad."""
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    made = index.agg(F.count("*").alias("vectors"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"), F.count_if(F.col(vector).isNull() | F.coalesce(squares == 0, F.lit(True))).alias("bad"))
    return made.withColumn("valid", F.coalesce((F.col("least") == F.col("most")) & (F.col("bad") == 0), F.lit(False)))


def envelope(kind: Column, payload: Column, event: Column, at: Column, version: int = 1) -> tuple[Column, Column]:
    """Canonical JSON of a versioned event (keys in order), and whether its payload is a JSON object."""
    valid = F.coalesce(F.get_json_object(payload, "$").isNotNull() & F.regexp_like(payload, F.lit(r"^\s*\{")), F.lit(False))
    body = F.struct(event.cast("string").alias("event_id"), kind.alias("event_type"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.from_json(payload, "map<string,string>").alias("payload"), F.lit(version).alias("schema_version"))
    return F.to_json(body), valid


def retained(rows: DataFrame, at: str, days: int) -> DataFrame:
    """``rows`` with ``kept``: whether a row is at most ``days`` older than the newest; null times are kept."""
    newest = rows.agg(F.max(at).alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).withColumn("kept", F.coalesce(F.col(at) >= F.col("newest") - F.make_dt_interval(F.lit(days)), F.lit(True))).drop("newest")  # one row


def iso_timestamp(value: Column) -> Column:
    """A timestamp of ISO 8601 text, null if it is none."""
    return F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")), F.try_to_timestamp(value))
