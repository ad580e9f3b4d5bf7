"""Analyses of one or more windows, each a single plan over all series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import interpolate, strict_class
from ..operators import bars as B
from ..operators import estimators as E
from ..operators import relation as R
from ..operators import resample as S
from ..operators.bars import KEYS
from ..schema import LAGS, MIN_PAIRED, MIN_SPREAD_ROWS, PANEL_MOVES, PANEL_ROWS, REGIME_ROWS, SWEEP_LAGS


def counted(paired: DataFrame) -> DataFrame:
    return paired.groupBy(*KEYS).agg(F.count("*").alias("minutes"))


def enough(paired: DataFrame, least: int = MIN_PAIRED) -> DataFrame:
    """Only series with so many rows."""
    long = counted(paired).where(F.col("minutes") >= least).select(F.col("window").alias("_w"), F.col("symbol").alias("_s"))
    return paired.join(long, (F.col("window") == F.col("_w")) & (F.col("symbol") == F.col("_s")), "left_semi")


def robustness(paired: DataFrame, cover: DataFrame, draws: int = S.DRAWS, least: int = MIN_PAIRED, lags: int = LAGS) -> DataFrame:
    """Every check of every series: unit root of the spread, weight and speeds, share bounds, bootstrap,
    agreement of both estimators, verdict.  Series below the floor keep their coverage only."""
    logs = E.log_prices(enough(paired, least))
    fit = E.hasbrouck(E.vecm_fit(logs, lags))
    root = E.adf(E.demeaned(logs, F.col("a") - F.col("b")), lags=lags).select(*KEYS, "adf", "half_life", "stationary")
    boot = S.bootstrap_summary(S.bootstrap_fits(logs, draws, lags)).select(*KEYS, "lead_share", "speed_a_low", "speed_a_high", "speed_b_low", "speed_b_high", "speeds_separated")
    fit = fit.select(*KEYS, "w_a", "speed_a", "speed_b", "is_low", "is_high", "rho", ((F.col("w_a") > 0.5) == ((F.col("is_low") + F.col("is_high")) / 2 > 0.5)).alias("agree"))
    out = cover.join(fit, KEYS, "left").join(root, KEYS, "left").join(boot, KEYS, "left")
    return out.withColumn("verdict", F.when(F.col("paired_minutes") >= least, "ranked").otherwise("too few paired minutes"))


def lag_sweep(paired: DataFrame, lags: tuple[int, ...] = SWEEP_LAGS) -> DataFrame:
    """A fit for each lag order; each has its own sample.  Refused ones do not appear.  The orders
    differ above the exchange only, so Spark reuses one exchange for all."""
    logs = E.log_prices(paired).select(*KEYS, "ts", "a", "b")
    parts = [E.vecm_fit(logs, n).withColumn("lags", F.lit(n)) for n in lags]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def grid_sweep(paired: DataFrame, width: int, lags: int = LAGS) -> DataFrame:
    """The series as they are and on a coarser grid; refused fits keep a row with NULLs."""
    fine, coarse = paired.withColumn("grid", F.lit("fine")), B.resample(paired, width).where("cex is not null and dex is not null").withColumn("grid", F.lit("coarse"))
    both = fine.select(*KEYS, "grid", "ts", "cex", "dex").union(coarse.select(*KEYS, "grid", "ts", "cex", "dex"))
    keys = [*KEYS, "grid"]
    rows = both.groupBy(*keys).agg(F.count("*").alias("grid_rows"))
    return rows.join(E.vecm_fit(E.log_prices(both), lags, keys), keys, "left")


def sessions(paired: DataFrame, least: int = MIN_PAIRED) -> DataFrame:
    """Whole window against the hours outside the session: rows are filtered before lags are taken."""
    shut = paired.where(~B.in_session(F.col("ts")))
    rows = paired.groupBy(*KEYS).agg(F.count("*").alias("minutes_all"), F.count_if(~B.in_session(F.col("ts"))).alias("minutes_shut"))
    all_ = E.vecm_fit(E.log_prices(paired)).select(*KEYS, F.col("w_a").alias("w_all"), F.col("leads").alias("leads_all"))
    closed = E.vecm_fit(E.log_prices(enough(shut, least))).select(*KEYS, F.col("w_a").alias("w_shut"), F.col("leads").alias("leads_shut"))
    return rows.join(all_, KEYS, "left").join(closed, KEYS, "left")


def threshold(paired: DataFrame, floor: int = MIN_PAIRED) -> DataFrame:
    """Every series fitted whichever side of the floor it falls; NULL where the fit is refused."""
    fit = E.vecm_fit(E.log_prices(paired)).select(*KEYS, "speed_a", "speed_b", "w_a", "leads")
    return counted(paired).withColumn("kept", F.col("minutes") >= floor).join(fit, KEYS, "left")


def floor_summary(table: DataFrame) -> DataFrame:
    """Kept, fitted below the floor, and refused series, by window."""
    group = F.when(F.col("kept"), "kept").when(F.col("w_a").isNotNull(), "below").otherwise("refused")
    out = table.withColumn("band", group).groupBy("window", "band")
    return out.agg(F.count("*").alias("series"), F.count_if("leads").alias("leaning"), F.percentile("w_a", 0.5).alias("median_w"), F.min("minutes").alias("least"), F.max("minutes").alias("most"), F.count_if((F.col("w_a") < 0) | (F.col("w_a") > 1)).alias("outside"))


def alignment(paired: DataFrame, step: int, lags: int = LAGS) -> DataFrame:
    """As collected against realigned bars: rows, weights, spread deviation in basis points, unit roots,
    and the lag profile."""
    moved = B.realign(paired, step)

    def side(p: DataFrame, name: str) -> DataFrame:
        logs = E.log_prices(p)
        n = counted(p).withColumnRenamed("minutes", f"rows_{name}")
        fit = E.vecm_fit(logs, lags).select(*KEYS, F.col("w_a").alias(f"w_{name}"), F.col("leads").alias(f"leads_{name}"))
        sd = logs.groupBy(*KEYS).agg(F.when(F.count("*") >= MIN_SPREAD_ROWS, F.stddev_samp(F.col("a") - F.col("b")) * 1e4).alias(f"spread_sd_bp_{name}"))
        root = E.adf(E.demeaned(logs, F.col("a") - F.col("b")), lags=lags).select(*KEYS, F.col("stationary").alias(f"stationary_{name}"))
        return n.join(fit, KEYS, "left").join(sd, KEYS, "left").join(root, KEYS, "left")

    out = side(paired, "as_collected").join(side(moved, "realigned"), KEYS, "left").withColumn("rows_realigned", F.coalesce("rows_realigned", F.lit(0)))
    return out.join(B.lag_profile(paired, 3, step).drop("profile"), KEYS, "left")


def alignment_summary(table: DataFrame, *groups: str) -> DataFrame:
    """What realigning changes over series with both weights: moves towards the first venue, the largest
    move against it, leads lost, strict classes before and after, medians of weights and of spread sizes."""
    move = F.col("w_realigned") - F.col("w_as_collected")
    sides = [(s, F.col(f"w_{s}")) for s in ("as_collected", "realigned")]
    counts = [F.count_if(strict_class(w) == c).alias(f"{c}_{s}") for s, w in sides for c in ("cex", "dex", "unclassified")]
    return table.where("w_as_collected is not null and w_realigned is not null").groupBy(*groups).agg(
        F.count("*").alias("series"), F.count_if(move > 0).alias("moved_towards"), F.max(F.when(move < 0, -move)).alias("largest_against"), F.count_if((F.col("w_as_collected") > 0.5) & (F.col("w_realigned") <= 0.5)).alias("leads_lost"), *counts,
        *[F.percentile(w, 0.5).alias(f"median_w_{s}") for s, w in sides], *[F.percentile(f"spread_sd_bp_{s}", 0.5).alias(f"median_sd_{s}") for s, _ in sides],
    )


def crossings(table: DataFrame) -> DataFrame:
    """Series of sessions() whose leader outside the session is another than over the whole window."""
    return table.where((F.col("w_all") > 0.5) != (F.col("w_shut") > 0.5))


def crossing_summary(table: DataFrame) -> DataFrame:
    """How many series cross, and how many of their weights are inside the strict band."""
    inside = lambda c: F.count_if(strict_class(F.col(c)) == "unclassified")
    return crossings(table).agg(F.count("*").alias("crossings"), (inside("w_all") + inside("w_shut")).alias("in_band"))


def widened(table: DataFrame, rows: str, column: str, labels: list, value: str, name: str) -> DataFrame:
    """One column ``name``_label for each label: the average of value, NULL where there is none."""
    wide = table.groupBy(rows).pivot(column, labels).agg(F.avg(value))
    return wide.select(rows, *[F.col(f"`{x}`").alias(f"{name}_{x}") for x in labels])


def flips(table: DataFrame) -> DataFrame:
    """(leaders, of): distinct leaders of each symbol over refitted settings, as counts of symbols."""
    per = table.where("leads is not null").groupBy("symbol").agg(F.countDistinct("leads").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("changed"), F.count_if(F.col("n") == 1).alias("same"), F.count("*").alias("symbols"))


def checks_table(aligned: DataFrame, robust: DataFrame, vector: DataFrame, risk: DataFrame, spaced: DataFrame, lags: DataFrame, grid: DataFrame, dep: DataFrame, below: DataFrame, across: DataFrame) -> DataFrame:
    """(at, question, method, result, tone): the twelve checks of a study, each one line of text.

    Every input is the frame of its study (spaced: mean_step and w_a of each series).  A check that found
    something, or that only probes, has an empty tone."""
    pct = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    text = lambda form, *c: F.format_string(form, *[F.col(x) if isinstance(x, str) else x for x in c])
    fitted = aligned.where("w_realigned is not null").agg(F.count_if(F.col("w_realigned") > 0.5).alias("a"), F.count("*").alias("n"), F.count_if(F.col("w_as_collected") > 0.5).alias("b"))
    held = robust.agg(F.count_if("stationary").alias("s"), F.count_if("agree").alias("g"), F.count("*").alias("n"), F.min("lead_share").alias("lo"), F.max("lead_share").alias("hi"))
    lean = below.agg(F.count_if(F.col("w_a") > 0.5).alias("a"), F.count("w_a").alias("n"), F.percentile("w_a", 0.5).alias("m"), F.count_if(F.col("w_a").isNull()).alias("thin"))
    legs = dep.agg(F.max(F.when(F.col("leg") == "spread", F.col("median"))).alias("s"), F.max(F.when(F.col("leg") == "cex", F.col("median"))).alias("c"))
    rows: list[tuple[str, str, DataFrame, Column, str]] = [
        ("Did both tapes mean the same instant", "refitted on the corrected alignment", fitted, text("first venue ahead in %d of %d, against %d as collected", "a", "n", "b"), ""),
        ("Are the two series cointegrated at all", "augmented Dickey-Fuller on each spread", held, text("stationary in %d of %d", "s", "n"), "pass"),
        ("Does imposing a one-for-one error term matter", "cointegrating vector fitted instead", vector.agg(F.count_if("same_leader").alias("a"), F.count("*").alias("n")), text("same leader in %d of %d", "a", "n"), "pass"),
        ("Does a second estimator agree", "Hasbrouck information shares", held, text("same direction in %d of %d", "g", "n"), "pass"),
        ("Can the token's own data support it", "block bootstrap over the fitted rows", held, text("first venue ahead in %s to %s of resamples", pct("lo"), pct("hi")), "pass"),
        ("Could sparse trading have invented it", "simulation with the second venue as known leader", risk.agg(F.min("false_lead_drop").alias("lo"), F.max("false_lead_drop").alias("hi")), text("error %s to %s at these fill rates", pct("lo"), pct("hi")), "pass"),
        ("Do the sparser pairs read differently", "spacing against the weight, across every ranked series", R.spearman(spaced, "mean_step", "w_a"), text("rank correlation %+.2f over %d series", "rho", "n"), "pass"),
        ("Does the answer depend on the lag order", "refitted at several lags", flips(lags), text("leader changes in %d of %d", "changed", "symbols"), "pass"),
        ("Does it depend on the grid", "refitted on coarser bars", flips(grid), text("same leader in %d of %d", "same", "symbols"), "pass"),
        ("Are the pairs separate draws or one market", "cross-token correlation of the spread the model fits", legs, text("%.2f, against %.2f on the first venue's legs", "s", "c"), "pass"),
        ("Does the floor pick its own answer", "the estimator run below the floor", lean, text("%d of %d lean the same way, median %.2f, %d too thin to fit", "a", "n", "m", "thin"), ""),
        ("Does it survive different days", "collection repeated", across.where("windows_ranked > 0").agg(F.count_if("led_every_window").alias("a"), F.count("*").alias("n")), text("led in every window ranked, %d of %d tokens", "a", "n"), "pass"),
    ]
    out = None
    for at, (question, method, frame, result, tone) in enumerate(rows):
        one = frame.select(F.lit(at).alias("at"), F.lit(question).alias("question"), F.lit(method).alias("method"), result.alias("result"), F.lit(tone).alias("tone"))
        out = one if out is None else out.union(one)
    return out


def staleness_risk(cover: DataFrame, runs: DataFrame) -> DataFrame:
    """The false-lead rates that the sampling simulation gives at each series' fill rate; cover has fill_rate,
    runs is the simulation of both schemes at one length."""
    per = runs.where("leads is not null").groupBy("keep").agg(*[F.avg(F.when(F.col("scheme") == s, F.col("leads").cast("double"))).alias(f"rate_{s}") for s in ("drop", "hold")])
    curve = runs.sparkSession.createDataFrame(per.collect(), per.schema)  # one row for each share kept
    out = cover
    for s in ("drop", "hold"):
        out = interpolate(out, curve, "keep", f"rate_{s}", "fill_rate", f"false_lead_{s}")
    return out


def session_panel(paired: DataFrame) -> DataFrame:
    """Each regime with 30 rows or more: moves and premium, and the fit where rows and moves suffice."""
    parts = B.regimes(paired)
    keys = [*KEYS, "regime"]
    stats = B.moves(parts, "regime").where(F.col("minutes") >= REGIME_ROWS)
    gate = (F.col("minutes") >= PANEL_ROWS) & (F.col("cex_moves") >= PANEL_MOVES) & (F.col("dex_moves") >= PANEL_MOVES)
    fit = E.vecm_fit(E.log_prices(parts), keys=keys).select(*keys, "w_a", "speed_a", "speed_b")
    out = stats.join(fit, keys, "left")
    return out.select(*keys, "minutes", "cex_moves", "dex_moves", "mean_gap_pct", *[F.when(gate, F.col(c)).alias(c) for c in ("w_a", "speed_a", "speed_b")])


def venue_matrix(bars: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Any two venues against each other: the pair's name takes the window's place while fitting."""
    out = None
    for a, b in pairs:
        p = B.pair_up(bars, a, b).withColumns({"venue_a": F.lit(str(a)), "venue_b": F.lit(str(b))})
        out = p if out is None else out.union(p)
    keys = [*KEYS, "venue_a", "venue_b"]
    stats = B.moves(out, "venue_a", "venue_b").withColumnsRenamed({"cex_moves": "moves_a", "dex_moves": "moves_b"})
    gate = (F.col("minutes") >= PANEL_ROWS) & (F.col("moves_a") >= PANEL_MOVES) & (F.col("moves_b") >= PANEL_MOVES)
    fit = E.vecm_fit(E.log_prices(out), keys=keys).select(*keys, "w_a", "speed_a", "speed_b")
    return stats.join(fit, keys, "left").select(*keys, "minutes", "moves_a", "moves_b", *[F.when(gate, F.col(c)).alias(n) for c, n in (("w_a", "weight_a"), ("speed_a", "speed_a"), ("speed_b", "speed_b"))])


def dependence(paired: DataFrame, step: int, least: int) -> DataFrame:
    return R.dependence(R.pair_correlations(R.legs(E.log_prices(paired), step)), least)
