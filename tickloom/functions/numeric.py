"""Numeric column functions with the null rules of the engine: what would be NaN is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STRICT_HIGH, STRICT_LOW, TINY


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, NaN as NULL, no negative zero."""
    return F.round(F.nanvl(x, F.lit(None).cast("double")), digits) + F.lit(0.0)


def correlation(x: str, y: str, where: Column | None = None) -> Column:
    """Pearson correlation over rows with both; NULL with no variance."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = ok if where is None else ok & where
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(column: str, *groups: str) -> Column:
    """Rank with ties sharing their mean rank, from 1."""
    by = Window.partitionBy(*groups)
    return F.rank().over(by.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, column)) - 1) / F.lit(2.0)


def weight(speed_a: Column, speed_b: Column) -> Column:
    """Leadership weight of a; NULL when the speeds (nearly) agree."""
    gap = speed_a - speed_b
    return F.when(F.abs(gap) >= TINY, -speed_b / gap)


def leads(speed_a: Column, speed_b: Column) -> Column:
    """a leads: the same as weight > 1/2, without dividing."""
    return F.abs(speed_a) < F.abs(speed_b)


def strict_class(w: Column, high: str = "cex", low: str = "dex") -> Column:
    return F.when(w > STRICT_HIGH, high).when(w < STRICT_LOW, low).when(w.isNotNull(), "unclassified")


def sign_test(led: Column, total: Column) -> Column:
    """Exact two-sided binomial p at 1/2; NULL without trials or with impossible counts."""
    n = total.cast("int")
    k = F.greatest(led, total - led).cast("int")
    choose = F.aggregate(
        F.sequence(F.lit(0), n),
        F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct((acc["c"] * (n - i) / (i + 1)).alias("c"), (acc["s"] + F.when(i >= k, acc["c"]).otherwise(0.0)).alias("s")),
    )["s"]
    return F.when((total > 0) & (led >= 0) & (led <= total), F.least(F.lit(1.0), F.lit(2.0) * choose / F.pow(F.lit(2.0), n)))


def effective_count(n: Column, rho: Column) -> Column:
    """Independent observations that n with mean correlation rho amount to."""
    return n / (F.lit(1.0) + (n - 1) * F.greatest(F.lit(0.0), rho))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only; SQL engines agree on it."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_index(size: Column, *parts: Column) -> Column:
    """An index in [0, size) from the same hash."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % size


def epoch(ts: str) -> Column:
    """Epoch seconds of a timestamp without time zone, whatever the session's zone."""
    c = F.col(ts)
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))


def interpolate(points: DataFrame, curve: DataFrame, x: str, y: str, at: str, out: str) -> DataFrame:
    """Adds out: the curve's y at points' ``at``, piecewise linear, clamped at both ends.

    The curve is a small table (one row per knot); it is joined as ranges between neighbours."""
    w = Window.partitionBy(F.lit(1)).orderBy(x)
    ends = curve.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    knots = curve.select(F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"))
    low, high = ends.first()
    v = F.least(F.greatest(F.col(at), F.lit(low)), F.lit(high))
    on = (v >= F.col("_x0")) & ((v < F.col("_x1")) | (F.col("_x1").isNull()))
    share = F.coalesce(F.try_divide(v - F.col("_x0"), F.col("_x1") - F.col("_x0")), F.lit(0.0))
    return points.join(knots, on, "left").withColumn(out, F.col("_y0") + share * (F.coalesce("_y1", "_y0") - F.col("_y0"))).drop("_x0", "_y0", "_x1", "_y1")
