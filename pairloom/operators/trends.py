"""Time series of incidents: calendar windows, moving averages, trends, outliers, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _series() -> WindowSpec:
    """In order of time; a series has one row per calendar window, so it is small."""
    return Window.orderBy("start")


def window_label(start: Column, unit: str) -> Column:
    """Label of a window: a day, ISO week, month, quarter or year."""
    if unit == "week":
        iso_year = F.year(F.date_add(F.date_trunc("week", start).cast("date"), 3))
        return F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    if unit == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def window_end(start: Column, unit: str) -> Column:
    """Start of the following window."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 12 MONTH"}
    return start + F.expr(step[unit])


def by_window(incidents: DataFrame, unit: str) -> DataFrame:
    """Incidents by calendar window: counts, scores, severities, distinct documents."""
    start = F.date_trunc(unit, "flagged_at")
    made = incidents.where(F.col("flagged_at").isNotNull()).groupBy(start.alias("start")).agg(
        F.count("*").alias("incident_count"),
        F.round(F.avg("score"), 6).alias("avg_similarity"),
        F.max("score").alias("max_similarity"),
        *[F.count_if(F.lower("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")],
        F.countDistinct("doc_a").alias("unique_documents"),
        F.countDistinct("doc_b").alias("unique_matchees"),
    )
    return made.withColumn("end", window_end(F.col("start"), unit)).withColumn("label", window_label(F.col("start"), unit))


def moving_average(series: DataFrame, value: str, period: int, digits: int = 4) -> DataFrame:
    """Mean of the last ``period`` values, of fewer at the start."""
    return series.withColumn("moving_average", F.round(F.avg(value).over(_series().rowsBetween(1 - period, 0)), digits))


def running_total(series: DataFrame, value: str) -> DataFrame:
    return series.withColumn("running_total", F.sum(value).over(_series().rowsBetween(Window.unboundedPreceding, 0)))


def deltas(series: DataFrame, value: str) -> DataFrame:
    """Change from the row before, also in percent (0 after a 0)."""
    before = F.lag(value).over(_series())
    return series.withColumn("delta", F.col(value) - before).withColumn("pct_change", F.when(before.isNull(), None).when(before == 0, 0.0).otherwise(F.round((F.col(value) - before) / before * 100, 2)))


def growth_rate(series: DataFrame, value: str) -> DataFrame:
    """Mean relative change; after 0 a rise counts 1 and a standstill 0."""
    before = F.lag(value).over(_series())
    rate = F.when(before > 0, (F.col(value) - before) / before).when(before.isNotNull() & (F.col(value) > 0), 1.0).when(before.isNotNull(), 0.0)
    return series.select(rate.alias("rate")).agg(F.coalesce(F.round(F.avg("rate"), 4), F.lit(0.0)).alias("growth_rate"))


def volatility(series: DataFrame, value: str) -> DataFrame:
    """Population standard deviation of first differences; 0 for a single value."""
    change = F.col(value) - F.lag(value).over(_series())
    return series.select(change.alias("d")).agg(F.coalesce(F.round(F.stddev_pop("d"), 6), F.lit(0.0)).alias("volatility"))


def linear_trend(series: DataFrame, value: str) -> DataFrame:
    """Slope, intercept and R squared of the values over their positions from 0."""
    placed = series.select((F.row_number().over(_series()) - 1).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    return placed.agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 4).alias("r_squared"))


def forecast(series: DataFrame, value: str, periods: int = 3) -> DataFrame:
    """The linear trend carried on, not below 0; 1 is the window after the last."""
    placed = series.select((F.row_number().over(_series()) - 1).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    line = placed.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("b"))
    ahead = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
    return ahead.select("period", F.round(F.greatest(F.lit(0.0), F.col("m") * (F.col("n") + F.col("period") - 1) + F.col("b")), 2).alias("predicted"))


def z_outliers(series: DataFrame, value: str, threshold: float, sample: bool) -> DataFrame:
    """Rows whose value is ``threshold`` deviations or more from the mean; none among fewer than three."""
    one = Window.partitionBy()
    deviation = (F.stddev_samp(value) if sample else F.stddev_pop(value)).over(one)
    z = (F.col(value) - F.avg(value).over(one)) / F.nullif(deviation, F.lit(0.0))
    scored = series.withColumn("z_score", F.round(z, 4)).withColumn("n", F.count("*").over(one))
    return scored.where((F.col("n") >= 3) & (F.abs("z_score") >= threshold)).withColumn("direction", F.when(F.col("z_score") > 0, "spike").otherwise("dip")).drop("n")


def compare_periods(rows: DataFrame, ts: str, value: str, recent_days: int, baseline_days: int) -> DataFrame:
    """Mean of the last days against the days before them; no row if either is empty."""
    last = rows.agg(F.max(ts).alias("last"))
    near = F.col("last") - F.expr(f"INTERVAL {recent_days} DAY")
    far = F.col("last") - F.expr(f"INTERVAL {recent_days + baseline_days} DAY")
    placed = rows.crossJoin(F.broadcast(last)).select(F.col(value).alias("v"), (F.col(ts) >= near).alias("recent"), ((F.col(ts) >= far) & (F.col(ts) < near)).alias("base"))
    both = placed.agg(
        F.avg(F.when(F.col("recent"), F.col("v"))).alias("r"), F.avg(F.when(F.col("base"), F.col("v"))).alias("b"), F.count_if("recent").alias("recent_count"), F.count_if("base").alias("baseline_count")
    ).where("recent_count > 0 AND baseline_count > 0")
    change = F.when(F.col("b") != 0, (F.col("r") - F.col("b")) / F.abs("b")).otherwise(0.0)
    return both.select(F.round("r", 6).alias("recent_mean"), F.round("b", 6).alias("baseline_mean"), F.round(F.col("r") - F.col("b"), 6).alias("absolute_change"), F.round(change, 6).alias("percent_change"), "recent_count", "baseline_count")


def bursts(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Gaps between a key's events: mean, share below ``seconds``, index of dispersion."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(Window.partitionBy(key).orderBy(ts, "event_id"))) / 1e6
    gaps = events.select(key, gap.alias("gap")).where("gap >= 0")
    made = gaps.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.var_samp("gap").alias("var"), F.avg((F.col("gap") < seconds).cast("double")).alias("ratio"))
    dispersion = F.when((F.col("n") > 1) & (F.col("mean") > 0), F.round(F.col("var") / F.col("mean"), 2))
    return made.select(key, "n", F.round("mean", 3).alias("mean_gap"), F.round("ratio", 6).alias("burst_ratio"), dispersion.alias("dispersion"), ((F.col("n") >= 10) & (F.col("var") / F.col("mean") > 3)).alias("anomalous"))


def spikes(rows: DataFrame, key: str, ts: str, value: str, size: int = 60, least: int = 10, threshold: float = 3.0) -> DataFrame:
    """Values over ``threshold`` deviations from the mean of the last ``size``, themselves included."""
    last = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(1 - size, 0)
    placed = rows.withColumns({"n": F.count(value).over(last), "mean": F.avg(value).over(last), "sd": F.stddev_pop(value).over(last)})
    z = (F.col(value) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return placed.where(F.col("n") >= least).withColumn("z", z).where(F.abs("z") > threshold).select("event_id", key, ts, value, F.round("z", 4).alias("z"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    made = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return made.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
