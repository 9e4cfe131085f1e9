"""Distribution functions as Columns: the normal one, and two-tailed p-values of Student's t."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import let

#: Terms of the series; enough for |x| up to REACH, beyond which the value is 0 or 1.
TERMS, REACH = 140, 8.0
#: Terms of the incomplete beta function.
BETA_TERMS = 400


def erf(x: Column) -> Column:
    """The error function, by a series whose terms all have one sign; null stays null."""

    def series(y: Column) -> Column:
        step = lambda a, n: F.struct((a["t"] * 2 * y * y / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * y * y / (2 * n + 1)).alias("s"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(y.alias("t"), y.alias("s")), step, lambda a: a["s"])
        return F.when(F.abs(y) >= REACH, F.signum(y)).otherwise(total * F.exp(-y * y) * 1.1283791670955126)  # 2 / sqrt(pi)

    return let(x.cast("double"), series)


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / 1.4142135623730951)) / 2


def _beta_ratio(a: Column) -> Column:
    """1 / B(a, 1/2) for a multiple of one half, from the ratio of gamma functions at 1/2 or 1."""
    whole = a == F.floor(a)
    first, start = F.when(whole, 1.0).otherwise(0.5), F.when(whole, 0.8862269254527579).otherwise(0.5641895835477563)  # sqrt(pi) / 2, 1 / sqrt(pi)
    steps = F.when(a > first, F.sequence(F.lit(0), (a - first).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    ratio = F.aggregate(steps, start, lambda r, i: r * (first + i + 0.5) / (first + i))
    return ratio / 1.7724538509055159  # sqrt(pi)


def _beta_series(x: Column, a: Column, b: Column, ratio: Column) -> Column:
    """The incomplete beta function, by its power series."""
    step = lambda s, n: F.struct((s["t"] * (a + b + n) / (a + 1 + n) * x).alias("t"), (s["s"] + s["t"] * (a + b + n) / (a + 1 + n) * x).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(BETA_TERMS)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda s: s["s"])
    return F.pow(x, a) * F.pow(1 - x, b) / a * ratio * total


def t_two_tailed(t: Column, df: Column) -> Column:
    """Probability of a t at least as far from 0, for a whole number of degrees of freedom; null below one degree."""

    def value(p: Column) -> Column:
        t, df = p["t"], p["df"]
        x, a, b = df / (df + t * t), df / 2, F.lit(0.5)
        ratio = _beta_ratio(a)
        # the series runs fast on the side of the smaller argument, and on the other side needs some df / t^2 terms
        direct = (x <= (a + 1) / (a + b + 2)) & (df <= 20 * t * t)
        made = F.when(direct, _beta_series(x, a, b, ratio)).otherwise(1 - _beta_series(1 - x, b, a, ratio))
        return F.when(df >= 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), made)))

    return let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("df")), value)
