"""Relations across symbols and windows: ranks, ratios, groups, dependence, leadership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, correlation, effective_count, ratio
from ..schema import DEAD_BELOW, MIN_OVERLAP
from .bars import KEYS, premium_ratio, step_changes


def spearman(frame: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """(groups, rho, n): correlation of average ranks over rows with both."""
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_rx": average_rank(x, *groups), "_ry": average_rank(y, *groups)})
    agg = (correlation("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    return ranked.groupBy(*groups).agg(*agg)


def trimmed(frame: DataFrame, by: str, top: int, *groups: str) -> DataFrame:
    """Without the ``top`` rows largest in ``by`` (ties: the later symbol stays)."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(by), "symbol"))
    return frame.withColumn("_r", rank).where(F.col("_r") > top).drop("_r")


def ratio_relation(volumes: DataFrame, trim: int = 6, least: int = 10) -> DataFrame:
    """For each window, activity (paired_min) against cex volume over dex volume: rank correlation,
    the same without the ``trim`` largest ratios (NULL with fewer than ``least`` left), dex liquidity's
    rank correlation, and the ratio's median and maximum.

    volumes: (window, symbol, paired_min, cex_vol, dex_vol, liquidity)."""
    v = volumes.withColumn("ratio", premium_ratio(F.col("cex_vol"), F.col("dex_vol")))
    whole = spearman(v, "paired_min", "ratio", "window").withColumnRenamed("n", "tokens")
    cut = spearman(trimmed(v, "ratio", trim, "window"), "paired_min", "ratio", "window").select("window", F.when(F.col("n") >= least, F.col("rho")).alias("rho_trimmed"), F.col("n").alias("trimmed_tokens"))
    deep = spearman(v, "paired_min", "liquidity", "window").select("window", F.col("rho").alias("rho_liquidity"))
    stats = v.groupBy("window").agg(F.percentile("ratio", 0.5).alias("median_ratio"), F.max("ratio").alias("max_ratio"))
    return whole.join(cut, "window", "left").join(deep, "window", "left").join(stats, "window")


def build_groups(universe: DataFrame, minutes: DataFrame, rankable: Column, dead_below: int = DEAD_BELOW) -> DataFrame:
    """Universe rows with paired_min (NULL if unseen), ratio, and group: dead, ranked or thin.
    A NULL count is not below anything, so it is ranked or thin."""
    joined = universe.join(minutes, "symbol", "left")
    group = F.when(F.col("paired_min") < dead_below, "dead").when(rankable, "ranked").otherwise("thin")
    return joined.withColumns({"ratio": premium_ratio(F.col("cex_volume_24h"), F.col("dex_volume_24h")), "group": group})


def legs(logs: DataFrame, step: int) -> DataFrame:
    """(window, leg, symbol, ts, change): one-step changes of cex, dex and their spread, long."""
    long = logs.select(*KEYS, "ts", F.explode(F.create_map(F.lit("cex"), F.col("a"), F.lit("dex"), F.col("b"), F.lit("spread"), F.col("a") - F.col("b"))).alias("leg", "x"))
    keyed = long.withColumns({"_s": F.col("symbol"), "symbol": F.concat_ws("|", "leg", "symbol")})
    return step_changes(keyed, "x", step).select("window", "leg", F.col("_s").alias("symbol"), "ts", "change")


def pair_correlations(changes: DataFrame) -> DataFrame:
    """(window, leg, sym_a, sym_b, overlap, corr) for all unordered pairs of symbols of a window and leg.

    Pairs that share no stamp have overlap 0: pairs come from the symbols' own small table, keyed by
    window and leg."""
    names = changes.select("window", "leg", "symbol").distinct()
    spine = names.withColumnRenamed("symbol", "sym_a").join(names.withColumnRenamed("symbol", "sym_b"), ["window", "leg"]).where("sym_a < sym_b")
    a = changes.select("window", "leg", "ts", F.col("symbol").alias("sym_a"), F.col("change").alias("xa"))
    b = changes.select("window", "leg", "ts", F.col("symbol").alias("sym_b"), F.col("change").alias("xb"))
    met = a.join(b, ["window", "leg", "ts"]).where("sym_a < sym_b").groupBy("window", "leg", "sym_a", "sym_b").agg(F.count("*").alias("overlap"), correlation("xa", "xb").alias("corr"))
    return spine.join(met, ["window", "leg", "sym_a", "sym_b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def dependence(pairs: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """For each window and leg: pairs, those with enough overlap, those below, median overlap (cut to a
    whole number), and median, mean, lowest and highest correlation of the kept ones."""
    kept = F.when(F.col("overlap") >= least, F.col("corr"))
    return pairs.withColumn("_c", kept).groupBy("window", "leg").agg(
        F.count("*").alias("token_pairs"), F.count("_c").alias("usable_pairs"), F.count_if(F.col("overlap") < least).alias("pairs_below_floor"), F.floor(F.percentile("overlap", 0.5)).alias("median_overlap"),
        F.percentile("_c", 0.5).alias("median"), F.avg("_c").alias("mean"), F.min("_c").alias("low"), F.max("_c").alias("high"),
    )


def effective_pairs(summary: DataFrame, n: str, rho: str) -> DataFrame:
    return summary.withColumn("effective", effective_count(F.col(n).cast("double"), F.coalesce(F.col(rho), F.lit(0.0))))


def window_labels(frame: DataFrame, most: int = 1000) -> list[str]:
    """The windows of a frame in order; more than ``most`` are an error, as each becomes a column."""
    found = [r[0] for r in frame.select("window").distinct().orderBy("window").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} windows")
    return found


def leadership_across_windows(weights: DataFrame, labels: list[str]) -> DataFrame:
    """(symbol, a column for each label, windows_ranked, led_every_window, spread_across_windows) from
    (window, symbol, w_a).  The spread is NULL with fewer than two windows."""
    stats = weights.groupBy("symbol").agg(F.count("w_a").alias("windows_ranked"), F.coalesce(F.every(F.when(F.col("w_a").isNotNull(), F.col("w_a") > 0.5)), F.lit(False)).alias("led_every_window"), F.when(F.count("w_a") >= 2, F.max("w_a") - F.min("w_a")).alias("spread_across_windows"))
    wide = weights.groupBy("symbol").pivot("window", labels).agg(F.avg("w_a"))
    return wide.join(stats, "symbol")


def replication(fits: DataFrame, first: str, second: str) -> DataFrame:
    """Two windows side by side for symbols fitted in both, and whether cex leads in both."""
    side = lambda label, s: fits.where(F.col("window") == label).select("symbol", *[F.col(c).alias(f"{n}_{s}") for c, n in (("w_a", "w"), ("speed_a", "speed_cex"), ("speed_b", "speed_dex"), ("leads", "leads"))])
    both = side(first, "first").join(side(second, "second"), "symbol")
    return both.withColumn("leads_both", F.col("leads_first") & F.col("leads_second")).drop("leads_first", "leads_second")


def replication_drift(both: DataFrame) -> DataFrame:
    """Over all shared symbols of replication(): how many, led in both, and the largest change of weight."""
    return both.agg(F.count("*").alias("shared"), F.count_if("leads_both").alias("led_both"), F.max(F.abs(F.col("w_second") - F.col("w_first"))).alias("largest_drift"))


def lead_tally(fits: DataFrame, *groups: str) -> DataFrame:
    """Led and fitted, for each value of groups and over all (groups NULL)."""
    return fits.rollup(*groups).agg(F.count_if(F.col("leads")).alias("led"), F.count("*").alias("total"))


def median_split(frame: DataFrame, x: str, *groups: str) -> DataFrame:
    """Adds half: 'low' at or below the group's median of x, else 'high'."""
    mid = frame.groupBy(*groups).agg(F.percentile(x, 0.5).alias("_m"))
    joined = frame.join(mid, list(groups)) if groups else frame.crossJoin(F.broadcast(mid))  # one row
    return joined.withColumn("half", F.when(F.col(x) <= F.col("_m"), "low").otherwise("high")).drop("_m")


def share(part: Column, whole: Column) -> Column:
    return ratio(F.sum(F.when(part, whole).otherwise(0)), F.sum(whole))
