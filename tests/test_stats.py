"""Distribution functions against Python's and known values; sums over ranges."""

import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import stats
from pairloom.operators.ranges import running


def test_normal_cdf(spark):
    xs = [-9.0, -6.5, -2.0, -0.3, 0.0, 1e-9, 0.7, 1.959964, 3.5, 5.9, 12.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(stats.normal_cdf(F.col("x"))).collect()]
    for x, p in zip(xs, got, strict=True):
        assert p is None if x is None else p == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-12)


def test_t_two_tailed(spark):
    # Quantiles of the t distribution for a two-tailed probability of 0.05, 0.01 and so on.
    known = [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (3.18245, 3, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (4.032143, 5, 0.01), (2.0, 30, 0.05462), (0.0, 7, 1.0), (1.959964, 2000, 0.05014), (-2.228139, 10, 0.05), (1.0, 0, None)]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(known)], "i int, t double, n int").orderBy("i")
    for (_, _, want), r in zip(known, rows.select(stats.t_two_tailed(F.col("t"), F.col("n"))).collect(), strict=True):
        assert r[0] is None if want is None else r[0] == pytest.approx(want, abs=2e-5)


def test_running_sums(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5 if i % 9 else None) for i in range(200)], "k long, v long").repartition(6)
    got = {r.k: r.before for r in running(rows, "k", F.col("v"), "before").collect()}
    total = 0
    for i in range(200):
        assert got[i] == total
        total += ((i * 7) % 5) if i % 9 else 0
