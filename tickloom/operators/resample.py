"""Resampling with a counter-based hash generator: any engine that has md5 draws the same samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import draw_index, leads, weight
from ..schema import LAGS, vecm_minimum
from .bars import KEYS
from .estimators import _solved, solve, vecm_columns, vecm_design

DRAWS = 400
PERMUTATIONS = 20000
LEVEL = 0.90


def block_draws(design: DataFrame, draws: int, seed: int) -> DataFrame:
    """(keys, draw, block, start, width): where each block of each draw begins and how many rows it takes.

    With m design rows a block has size = max(10, round(m^(1/3))) rows; ceil(m / size) blocks make a
    draw and the last is cut to m rows in all.  Groups with m < 4 * size are left out."""
    sizes = design.groupBy(*KEYS).agg(F.count("*").alias("m")).withColumn("size", F.greatest(F.lit(10), F.round(F.pow("m", F.lit(1.0 / 3.0))).cast("long"))).where("m >= 4 * size")
    nb = F.ceil(F.col("m") / F.col("size"))
    spine = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
    start = draw_index(F.col("m") - F.col("size") + 1, F.lit(seed), F.col("symbol"), F.col("draw"), F.col("block"))
    width = F.least(F.col("size"), F.col("m") - F.col("block") * F.col("size"))
    return spine.select(*KEYS, "draw", "block", start.alias("start"), width.alias("width"), "m")


def bootstrap_fits(logs: DataFrame, draws: int = DRAWS, lags: int = LAGS, seed: int = 0) -> DataFrame:
    """(keys, draw, speed_a, speed_b, w_a, leads): a fit for each moving-block sample of the design rows.

    A block's Gram matrix is the difference of two running sums, so a draw costs its number of
    blocks and not its rows.  A series is a group here: one window of one symbol, whose length
    the window bounds; its blocks are summed in one Arrow group."""
    design = vecm_design(logs, lags).where(F.col("n") >= vecm_minimum(lags))
    cols = vecm_columns(lags)
    numbered = design.withColumn("idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts")) - 1)
    blocks = block_draws(design, draws, seed)
    i, j = np.triu_indices(len(cols))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"window": [], "symbol": [], "draw": [], "gram": [], "rows": []})
        left = left.sort_values("idx")
        x = np.column_stack([np.ones(len(left)) if c == "one" else left[c].to_numpy(float) for c in cols])
        run = np.vstack([np.zeros(len(i)), np.cumsum(x[:, i] * x[:, j], axis=0)])
        right = right.sort_values(["draw", "block"])
        a, w, d = (right[c].to_numpy(np.int64) for c in ("start", "width", "draw"))
        part = run[a + w] - run[a]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        total = np.add.reduceat(part, at, axis=0)
        return pd.DataFrame({"window": left["window"].iloc[0], "symbol": left["symbol"].iloc[0], "draw": d[at], "gram": list(total), "rows": np.add.reduceat(w, at)})

    # fresh key columns: both sides come from the same series
    fresh = [F.col(k).alias(k) for k in KEYS]
    keep, blocks = numbered.select(*fresh, "idx", *[c for c in cols if c != "one"]), blocks.select(*fresh, "draw", "block", "start", "width")
    grams = keep.groupBy(*KEYS).cogroup(blocks.groupBy(*KEYS)).applyInPandas(sums, "window string, symbol string, draw long, gram array<double>, rows long")

    def values(full: np.ndarray, f: pd.DataFrame) -> dict:
        b, _ = solve(full, 2)
        return {"speed_a": b[:, 1, 0], "speed_b": b[:, 1, 1]}

    fit = _solved(grams, len(cols), "speed_a double, speed_b double", values)
    return fit.withColumns({"w_a": weight(F.col("speed_a"), F.col("speed_b")), "leads": leads(F.col("speed_a"), F.col("speed_b"))})


def bootstrap_summary(fits: DataFrame, level: float = LEVEL) -> DataFrame:
    """(keys, draws, lead_share, bands of weight and speeds, speeds_separated) over draws with a weight."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    band = lambda c: [F.percentile(c, lo).alias(f"{c}_low"), F.percentile(c, hi).alias(f"{c}_high")]
    out = fits.where("w_a is not null").groupBy(*KEYS).agg(F.count("*").alias("draws"), F.avg(F.col("leads").cast("double")).alias("lead_share"), *band("w_a"), *band("speed_a"), *band("speed_b"))
    return out.withColumn("speeds_separated", F.abs("speed_a_high") < F.abs("speed_b_low"))


def permutation_test(ranked: DataFrame, draws: int, seed: int = 0, key: str = "id", x: str = "rx", y: str = "ry") -> DataFrame:
    """(rho, p_value, n, draws) of a rank correlation: the share of shuffles with one at least as far
    from 0.  ranked has one row per item with both ranks, a small table (items of one window).

    Shuffles are rows: each draw orders the items by a hash and deals y's ranks out in that order, so
    draws spread over tasks.  Only the sum of products changes between shuffles."""
    pos = Window.partitionBy("draw").orderBy("_h", key)
    base = ranked.select(key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    numbered = base.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key)))
    shuffled = base.select(key, F.col(y).alias("_y")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col(key)))).withColumn("_i", F.row_number().over(pos))
    stats = base.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.avg(F.col(x) * F.col(y)).alias("mxy"))
    sums = shuffled.select("draw", "_i", "_y").join(numbered.select("_i", F.col(x).alias("_x")), "_i").groupBy("draw").agg(F.avg(F.col("_x") * F.col("_y")).alias("m"))
    n, mx, my, sx, sy, mxy = stats.first()
    if not n or not sx or not sy:
        return ranked.sparkSession.createDataFrame([(None, None, n or 0, draws)], "rho double, p_value double, n long, draws int")
    rho = (mxy - mx * my) / (sx * sy)
    far = F.abs((F.col("m") - F.lit(mx) * F.lit(my)) / F.lit(sx * sy)) >= abs(rho) - 1e-12
    return sums.agg(F.lit(rho).alias("rho"), F.avg(far.cast("double")).alias("p_value"), F.lit(n).cast("long").alias("n"), F.count("*").cast("int").alias("draws"))
