"""Bars, pairing, coverage, spacing, sessions, alignment, dense grids, thinning."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio, uniform
from ..schema import MINUTE, SESSION_CLOSE, SESSION_OPEN

KEYS = ["window", "symbol"]


def ordered(*extra: str) -> Window:
    return Window.partitionBy(*KEYS, *extra).orderBy("ts")


def bars(ticks: DataFrame, width: int, value: str = "value", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Last positive value of each venue in each bucket; ticks has KEYS, venue, at (epoch s) and order."""
    bucket = (F.col("at") - F.pmod(F.col("at"), F.lit(width))).cast("long")
    good = ticks.where(F.col(value) > 0)
    return good.groupBy(*KEYS, "venue", bucket.alias("ts")).agg(F.max_by(value, F.struct(*order)).alias("close"))


def packed(frame: DataFrame, order: tuple[str, ...]) -> Column:
    """One value in the order of the columns.  Two whole numbers or instants are packed into a decimal,
    which an aggregate can hold in its hash map; a struct would make it sort all rows first."""
    kinds = dict(frame.dtypes)
    whole = {"bigint": lambda c: c, "int": lambda c: c, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp"))}
    if len(order) != 2 or any(kinds.get(c) not in whole for c in order):
        return F.struct(*order)
    high, low = (whole[kinds[c]](F.col(c)).cast("decimal(19,0)") for c in order)
    # |low| < 2 * 10**19, so that it cannot reach the next value of high
    return (high * F.lit(Decimal(2 * 10**19))).cast("decimal(38,0)") + low


def latest(pages: DataFrame, keys: list[str], value: str, page: str) -> DataFrame:
    """One value per key when pages overlap: the later page wins."""
    return pages.groupBy(*keys).agg(F.max_by(value, page).alias(value))


def pair_up(bars_: DataFrame, a, b) -> DataFrame:
    """Rows where both venues have a bar.  One conditional aggregate, so one shuffle and no join."""
    pick = lambda v: F.max(F.when(F.col("venue") == v, F.col("close")))
    return bars_.where(F.col("venue").isin(a, b)).groupBy(*KEYS, "ts").agg(pick(a).alias("cex"), pick(b).alias("dex")).where("cex is not null and dex is not null")


def pair_ticks(ticks: DataFrame, width: int, a, b, value: str = "value", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """pair_up(bars(ticks)) in a single aggregate: last positive value of either venue in each bucket."""
    bucket = (F.col("at") - F.pmod(F.col("at"), F.lit(width))).cast("long")

    by = packed(ticks, order)

    def last(v) -> Column:
        mine = F.col("venue") == v
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, by))

    good = ticks.where((F.col(value) > 0) & F.col("venue").isin(a, b))
    return good.groupBy(*KEYS, bucket.alias("ts")).agg(last(a).alias("cex"), last(b).alias("dex")).where("cex is not null and dex is not null")


def clip_overlap(bars_: DataFrame, a, b) -> DataFrame:
    """Bars inside the stretch that both venues cover."""
    side = lambda f, v: f(F.when(F.col("venue") == v, F.col("ts")))
    ends = bars_.groupBy(*KEYS).agg(*[side(f, v).alias(f"_{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, v in enumerate((a, b))])
    ends = ends.where("_lo0 is not null and _lo1 is not null").select(*KEYS, F.greatest("_lo0", "_lo1").alias("_lo"), F.least("_hi0", "_hi1").alias("_hi"))
    return bars_.join(ends, KEYS).where("ts between _lo and _hi").drop("_lo", "_hi")


def coverage(bars_: DataFrame, a, b, step: int = MINUTE) -> DataFrame:
    """Counts, fill rate and gaps of each pair, over the stretch that both venues cover.

    Gaps are whole steps between neighbouring paired rows; the median gap is cut to a whole number,
    and without gaps all three gap figures are 0."""
    inside = clip_overlap(bars_, a, b)
    per_ts = inside.groupBy(*KEYS, "ts").agg(F.count(F.when(F.col("venue") == a, 1)).alias("na"), F.count(F.when(F.col("venue") == b, 1)).alias("nb"))
    both = F.col("na") * F.col("nb") > 0
    paired_ts = F.when(both, F.col("ts"))
    before = F.last(paired_ts, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(both, F.floor((F.col("ts") - before) / step))
    out = per_ts.withColumns({"gap": gap, "pts": paired_ts}).groupBy(*KEYS).agg(
        F.sum("na").alias("cex_minutes"), F.sum("nb").alias("dex_minutes"), (F.floor((F.max("ts") - F.min("ts")) / step) + 1).alias("window_minutes"), F.count("pts").alias("paired_minutes"),
        F.floor(F.coalesce(F.percentile("gap", 0.5), F.lit(0.0))).alias("median_gap_min"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_min"),
        F.round(F.coalesce(F.avg((F.col("gap") == 1).cast("double")), F.lit(0.0)), 4).alias("consecutive_share"), F.min("pts").alias("first_ts"), F.max("pts").alias("last_ts"),
    )
    return out.withColumn("fill_rate", F.round(F.col("paired_minutes") / F.col("window_minutes"), 4))


def spacing(paired: DataFrame, step: int = MINUTE) -> DataFrame:
    """Mean and median distance of neighbouring rows, in steps."""
    gap = (F.col("ts") - F.lag("ts").over(ordered())) / F.lit(float(step))
    return paired.withColumn("gap", gap).groupBy(*KEYS).agg(F.avg("gap").alias("mean_step"), F.percentile("gap", 0.5).alias("median_step"), F.count("*").alias("paired_minutes"))


def moved(x: str, w: Window) -> Column:
    """1 where x differs from the row before; the first row counts as a move."""
    before = F.lag(x).over(w)
    return F.when(before.isNull() | (F.col(x) != before), 1).otherwise(0)


def moves(paired: DataFrame, *extra: str) -> DataFrame:
    """Rows, moves of each side and mean premium of cex over dex in percent."""
    w = ordered(*extra)
    marked = paired.withColumns({"ma": moved("cex", w), "mb": moved("dex", w)})
    return marked.groupBy(*KEYS, *extra).agg(F.count("*").alias("minutes"), F.sum("ma").alias("cex_moves"), F.sum("mb").alias("dex_moves"), F.avg((F.col("cex") / F.col("dex") - 1) * 100).alias("mean_gap_pct"))


def in_session(ts: Column) -> Column:
    """Monday to Friday, 13:30 to before 20:00 UTC; no holidays, no daylight saving."""
    minute, day = F.floor(ts / 60) % 1440, (F.floor(ts / 86400) + 3) % 7
    return (day < 5) & (minute >= SESSION_OPEN) & (minute < SESSION_CLOSE)


def regimes(paired: DataFrame) -> DataFrame:
    """Each row twice: regime 'all', and 'open' or 'closed'."""
    return paired.withColumn("regime", F.explode(F.array(F.lit("all"), F.when(in_session(F.col("ts")), "open").otherwise("closed"))))


def step_changes(series: DataFrame, x: str = "x", step: int = MINUTE, out: str = "change") -> DataFrame:
    """Changes over exactly one step of the clock; rows after a gap go."""
    w = ordered()
    return series.withColumn(out, F.when(F.col("ts") - F.lag("ts").over(w) == step, F.col(x) - F.lag(x).over(w))).where(F.col(out).isNotNull())


def realign(paired: DataFrame, step: int = MINUTE) -> DataFrame:
    """cex one row later against dex, where the next row is exactly one step away."""
    w = ordered()
    next_ts, next_cex = F.lead("ts").over(w), F.lead("cex").over(w)
    return paired.withColumns({"_t": next_ts, "_c": next_cex}).where(F.col("_t") - F.col("ts") == step).withColumn("cex", F.col("_c")).drop("_t", "_c")


def dense(paired: DataFrame, step: int = MINUTE) -> DataFrame:
    """A row for each step between the first and last stamp; empty steps are nulls."""
    spans = paired.groupBy(*KEYS).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = spans.select(*KEYS, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("ts"))
    return grid.join(paired, [*KEYS, "ts"], "left")


def lag_profile(paired: DataFrame, span: int = 3, step: int = MINUTE) -> DataFrame:
    """Correlation of cex changes with dex changes k steps before, k from -span to span.

    profile is array<struct<corr, lag>>; the best lag has the largest correlation, then the larger
    lag.  Logs are of positive prices only.  There is no least overlap."""
    w = ordered()
    logs = dense(paired, step).withColumns({"a": F.when(F.col("cex") > 0, F.log("cex")), "b": F.when(F.col("dex") > 0, F.log("dex"))})
    diff = logs.withColumns({"da": F.col("a") - F.lag("a").over(w), "db": F.col("b") - F.lag("b").over(w)})
    lags = list(range(-span, span + 1))
    shifted = diff.withColumns({f"b{i}": (F.lag("db", k) if k >= 0 else F.lead("db", -k)).over(w) for i, k in enumerate(lags)})
    entry = [F.struct(correlation("da", f"b{i}").alias("corr"), F.lit(k).alias("lag")) for i, k in enumerate(lags)]
    prof = shifted.groupBy(*KEYS).agg(F.array(*entry).alias("profile"))
    best = F.array_max(F.filter("profile", lambda x: x["corr"].isNotNull()))
    return prof.select(*KEYS, "profile", best["lag"].alias("best_lag"), F.element_at("profile", span + 1)["corr"].alias("corr_at_zero"), best["corr"].alias("corr_at_best"))


def resample(paired: DataFrame, width: int) -> DataFrame:
    """Last non-null value of each side in each bucket; empty buckets do not appear."""
    bucket = (F.col("ts") - F.pmod(F.col("ts"), F.lit(width))).cast("long")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ts"))).alias(x)
    return paired.groupBy(*KEYS, bucket.alias("b")).agg(last("cex"), last("dex")).withColumnRenamed("b", "ts")


def fill_forward(frame: DataFrame, *columns: str) -> DataFrame:
    """The last value seen, over the rows before."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def thin(paired: DataFrame, keep: float, seed: int, hold: bool, column: str = "dex") -> DataFrame:
    """A sparse sample of one side: each row keeps its value with chance ``keep`` (a hash of symbol, ts
    and seed decides), the first always.  hold: the last kept value stands in; else the row goes."""
    first = F.row_number().over(ordered()) == 1
    kept = first | (uniform(F.lit(seed), F.col("symbol"), F.col("ts")) < keep)
    marked = paired.withColumn("_k", kept)
    if not hold:
        return marked.where("_k").drop("_k")
    return fill_forward(marked.withColumn(column, F.when(F.col("_k"), F.col(column))), column).drop("_k")


def premium_ratio(a: Column, b: Column) -> Column:
    return ratio(a, F.greatest(b, F.lit(1)))
