"""Queries on time series of incidents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import trends as op
from pairloom.plans.base import WITH, incidents
from pairloom.runtime import table


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return op.by_window(incidents(spark, d), "month").select("start", "incident_count")


def _windows(unit: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return op.by_window(incidents(spark, d), unit)

    query.__name__ = f"trend_by_{unit}"
    query.__doc__ = f"Incidents by {unit}."
    return query


def trend_moving_average(spark: SparkSession, d: str) -> DataFrame:
    return op.moving_average(_monthly(spark, d), "incident_count", 3, 2)


def trend_running_total(spark: SparkSession, d: str) -> DataFrame:
    return op.running_total(_monthly(spark, d), "incident_count")


def trend_deltas(spark: SparkSession, d: str) -> DataFrame:
    return op.deltas(_monthly(spark, d), "incident_count")


def trend_growth_rate(spark: SparkSession, d: str) -> DataFrame:
    return op.growth_rate(_monthly(spark, d), "incident_count")


def trend_volatility(spark: SparkSession, d: str) -> DataFrame:
    return op.volatility(_monthly(spark, d), "incident_count")


def trend_linear(spark: SparkSession, d: str) -> DataFrame:
    return op.linear_trend(_monthly(spark, d), "incident_count")


def trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    return op.forecast(_monthly(spark, d), "incident_count")


def trend_outliers_population(spark: SparkSession, d: str) -> DataFrame:
    return op.z_outliers(_monthly(spark, d), "incident_count", 1.5, sample=False)


def trend_outliers_sample(spark: SparkSession, d: str) -> DataFrame:
    return op.z_outliers(_monthly(spark, d), "incident_count", 1.5, sample=True)


def trend_compare_periods(spark: SparkSession, d: str) -> DataFrame:
    return op.compare_periods(table(spark, d, "events"), "ts", "value", 7, 14)


def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    return op.bursts(table(spark, d, "events"), "user_id", "ts", 3600.0)


def event_spikes(spark: SparkSession, d: str) -> DataFrame:
    return op.spikes(table(spark, d, "events"), "user_id", "ts", "value")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return op.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


def event_hourly_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Hours of an event type with more than three events."""
    made = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return made.where("n > 3").select("event_type", F.col("w.start").alias("start"), "n")


def event_latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, by one aggregation."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), last).select("user_id", "ts", "x.event_type", "x.value")


def event_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median, deviation, quartiles by event type."""
    p = [F.round(F.percentile("value", q), 4).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))]
    made = table(spark, d, "events").groupBy("event_type")
    return made.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), *p, F.round(F.percentile("value", 0.75) - F.percentile("value", 0.25), 4).alias("iqr"))


def event_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Values in twenty equal bins from 0 to 500; values outside in bins 0 and 21."""
    bins = F.width_bucket("value", F.lit(0.0), F.lit(500.0), F.lit(20)).alias("bin")
    return table(spark, d, "events").groupBy(bins).agg(F.count("*").alias("n"))


def event_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Population skewness and excess kurtosis by event type, and whether they stand out."""
    made = table(spark, d, "events").groupBy("event_type").agg(F.round(F.skewness("value"), 4).alias("skewness"), F.round(F.kurtosis("value"), 4).alias("kurtosis"))
    return made.withColumn("anomalous", (F.abs("skewness") > 2) | (F.abs("kurtosis") > 7))


def event_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Values beyond 1.5 interquartile ranges of their event type."""
    rows = table(spark, d, "events")
    fence = rows.groupBy("event_type").agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.join(fence, "event_type").where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).select("event_id", "event_type", "value")


def event_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type, by day and in all, in one pass."""
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    made = rows.groupingSets([["event_type"], ["day"], []], "event_type", "day")
    return made.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def event_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy of each user's event types."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    total = counts.groupBy("user_id").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return total.select("user_id", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


QUERIES = {f.__name__: f for f in (
    *[_windows(u) for u in ("day", "week", "month", "quarter", "year")],
    trend_moving_average, trend_running_total, trend_deltas, trend_growth_rate, trend_volatility, trend_linear, trend_forecast,
    trend_outliers_population, trend_outliers_sample, trend_compare_periods, event_bursts, event_spikes, event_sessions, event_hourly_clusters,
    event_latest_per_user, event_statistics, event_histogram, event_distribution, event_iqr_outliers, event_grouping_sets, event_entropy,
)}

M = f"WITH {WITH}, m AS (SELECT date_trunc('month', flagged_at)::TIMESTAMP AS start, count(*) AS incident_count FROM inc GROUP BY 1)"
STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}
LABEL = {
    "day": "strftime(start, '%Y-%m-%d')", "week": "strftime(start, '%G-W%V')", "month": "strftime(start, '%Y-%m')",
    "quarter": "year(start) || '-Q' || quarter(start)", "year": "strftime(start, '%Y')",
}
Z = """{m}, z AS (SELECT *, (incident_count - avg(incident_count) OVER ()) / {sd}(incident_count) OVER () AS z FROM m)
SELECT start, incident_count, round(z, 4) AS z_score, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS direction FROM z WHERE abs(round(z, 4)) >= 1.5"""

SQL = {
    **{f"trend_by_{u}": f"""WITH {WITH}, w AS (
        SELECT date_trunc('{u}', flagged_at)::TIMESTAMP AS start, count(*) AS incident_count, round(avg(score), 6) AS avg_similarity, max(score) AS max_similarity,
        count(*) FILTER (severity = 'Low') AS low, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Critical') AS critical,
        count(DISTINCT doc_a) AS unique_documents, count(DISTINCT doc_b) AS unique_matchees FROM inc GROUP BY 1)
        SELECT *, start + INTERVAL {STEP[u]} AS "end", {LABEL[u]} AS label FROM w""" for u in STEP},
    "trend_moving_average": M + " SELECT *, round(avg(incident_count) OVER (ORDER BY start ROWS 2 PRECEDING), 2) AS moving_average FROM m",
    "trend_running_total": M + " SELECT *, CAST(sum(incident_count) OVER (ORDER BY start) AS BIGINT) AS running_total FROM m",
    "trend_deltas": M + """ SELECT *, incident_count - lag(incident_count) OVER (ORDER BY start) AS delta,
        round((incident_count - lag(incident_count) OVER (ORDER BY start)) / lag(incident_count) OVER (ORDER BY start)::DOUBLE * 100, 2) AS pct_change FROM m""",
    "trend_growth_rate": M + ", g AS (SELECT (incident_count - lag(incident_count) OVER (ORDER BY start)) / lag(incident_count) OVER (ORDER BY start)::DOUBLE AS r FROM m) SELECT round(avg(r), 4) AS growth_rate FROM g",
    "trend_volatility": M + ", g AS (SELECT incident_count - lag(incident_count) OVER (ORDER BY start) AS r FROM m) SELECT round(stddev_pop(r), 6) AS volatility FROM g",
    "trend_linear": M + """, x AS (SELECT row_number() OVER (ORDER BY start) - 1 AS x, incident_count AS y FROM m)
        SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r_squared FROM x""",
    "trend_forecast": M + """, x AS (SELECT row_number() OVER (ORDER BY start) - 1 AS x, incident_count AS y FROM m), l AS (SELECT count(*) AS n, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM x)
        SELECT CAST(p AS INTEGER) AS period, round(greatest(0.0, m * (n + p - 1) + b), 2) AS predicted FROM l, range(1, 4) t(p)""",
    "trend_outliers_population": Z.format(m=M, sd="stddev_pop"),
    "trend_outliers_sample": Z.format(m=M, sd="stddev_samp"),
    "trend_compare_periods": """WITH l AS (SELECT max(ts) AS last FROM events), p AS (
        SELECT avg(value) FILTER (ts >= last - INTERVAL 7 DAY) AS r, avg(value) FILTER (ts >= last - INTERVAL 21 DAY AND ts < last - INTERVAL 7 DAY) AS b,
        count(*) FILTER (ts >= last - INTERVAL 7 DAY) AS recent_count, count(*) FILTER (ts >= last - INTERVAL 21 DAY AND ts < last - INTERVAL 7 DAY) AS baseline_count FROM events, l)
        SELECT round(r, 6) AS recent_mean, round(b, 6) AS baseline_mean, round(r - b, 6) AS absolute_change, round((r - b) / abs(b), 6) AS percent_change, recent_count, baseline_count FROM p""",
    "event_bursts": """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
        a AS (SELECT user_id, count(*) AS n, avg(gap) AS mean, var_samp(gap) AS v, avg(CASE WHEN gap < 3600 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM g WHERE gap >= 0 GROUP BY 1)
        SELECT user_id, n, round(mean, 3) AS mean_gap, round(ratio, 6) AS burst_ratio, CASE WHEN n > 1 AND mean > 0 THEN round(v / mean, 2) END AS dispersion, n >= 10 AND v / mean > 3 AS anomalous FROM a""",
    "event_spikes": """WITH w AS (SELECT *, count(value) OVER k AS n, avg(value) OVER k AS m, stddev_pop(value) OVER k AS sd FROM events
        WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING))
        SELECT event_id, user_id, ts, value, round((value - m) / sd, 4) AS z FROM w WHERE n >= 10 AND sd > 0 AND abs((value - m) / sd) > 3""",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, s""",
    "event_hourly_clusters": "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "event_latest_per_user": """SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "event_statistics": """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.25), 4) AS p25,
        round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90,
        round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events GROUP BY 1""",
    "event_histogram": """SELECT CASE WHEN value IS NULL THEN NULL WHEN value < 0 THEN 0 WHEN value >= 500 THEN 21 ELSE CAST(floor(value / 25.0) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events GROUP BY 1""",
    "event_distribution": """WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), c AS (SELECT event_type, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1)
        SELECT event_type, round(m3 / m2 ** 1.5, 4) AS skewness, round(m4 / m2 ** 2 - 3, 4) AS kurtosis, abs(round(m3 / m2 ** 1.5, 4)) > 2 OR abs(round(m4 / m2 ** 2 - 3, 4)) > 7 AS anomalous FROM c""",
    "event_iqr_outliers": """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
        SELECT event_id, event_type, value FROM events JOIN f USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
    "event_grouping_sets": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (day), ())",
    "event_entropy": """WITH c AS (SELECT user_id, count(*) AS c FROM events GROUP BY user_id, event_type), t AS (SELECT user_id, sum(c) AS t FROM c GROUP BY 1)
        SELECT user_id, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS entropy FROM c JOIN t USING (user_id) GROUP BY 1""",
}
