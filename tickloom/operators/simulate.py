"""Two venues with a known leader, and sweeps of fits over simulated runs.

The recursion couples both prices at every step, which no window function expresses; each run is a
row and is simulated whole in an Arrow group, so runs spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.numeric import leads, weight
from ..schema import LAGS, vecm_minimum
from .estimators import solve

#: FIXED VALUE: standard deviation of the common innovation.
INNOVATION = 0.002
#: FIXED VALUES: speeds, seeds, lengths and shares kept of the published simulations.
SPEEDS = [(0.0, 0.4), (0.05, 0.4), (0.1, 0.4), (0.2, 0.4), (0.25, 0.25), (0.3, 0.3), (0.4, 0.1), (0.4, 0.05)]
SEEDS, KEEPS, MATCHED, RUNS = 12, [1.0, 0.8, 0.6, 0.45, 0.3, 0.2, 0.1, 0.05], ([250, 1000, 4000], [0.5, 0.25, 0.12]), 40


def prices(n: int, adjust_a: float, adjust_b: float, venue_shock: float, noise: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both price paths.  Each venue has the common innovation and its own shock, and closes its share
    of the gap of the step before; observation noise comes last.  Draws are whole arrays in this
    order: innovation, shock a, shock b, noise a, noise b."""
    rng = np.random.default_rng(seed)
    common, own_a, own_b = rng.normal(0.0, INNOVATION, n), rng.normal(0.0, venue_shock, n), rng.normal(0.0, venue_shock, n)
    err_a, err_b = rng.normal(0.0, noise, n), rng.normal(0.0, noise, n)
    a, b = np.zeros(n), np.zeros(n)
    x = y = 0.0
    for t, (u, v) in enumerate(zip((common + own_a)[1:].tolist(), (common + own_b)[1:].tolist(), strict=True), 1):
        gap = y - x
        x, y = x + u + adjust_a * gap, y + v - adjust_b * gap
        a[t], b[t] = x, y
    return np.exp(a + err_a), np.exp(b + err_b)


def fit_paths(a: np.ndarray, b: np.ndarray, lags: int = LAGS) -> tuple[float, float] | None:
    """Both adjustment speeds of one pair of paths; None when it is too short."""
    n = len(a)
    if n < vecm_minimum(lags):
        return None
    la, lb = np.log(a), np.log(b)
    da, db = np.diff(la), np.diff(lb)
    cols = [np.ones(n - lags - 1), (la - lb)[lags:-1]]
    for d in (da, db):
        cols += [d[lags - i : len(d) - i] for i in range(1, lags + 1)]
    z = np.column_stack([*cols, da[lags:], db[lags:]])
    beta, _ = solve((z.T @ z)[None], 2)
    return float(beta[0, 1, 0]), float(beta[0, 1, 1])


@udtf(returnType="t: int, a: double, b: double")
class SimulatedPair:
    """A table function: SELECT * FROM simulate_pair(n, adjust_a, adjust_b, venue_shock, noise, seed)."""

    def eval(self, n: int, adjust_a: float, adjust_b: float, venue_shock: float, noise: float, seed: int):
        a, b = prices(n, adjust_a, adjust_b, venue_shock, noise, seed)
        for t in range(n):
            yield t, float(a[t]), float(b[t])


def register(spark: SparkSession) -> None:
    spark.udtf.register("simulate_pair", SimulatedPair)


def _runs(params: DataFrame, extra: str, sample) -> DataFrame:
    """params rows with speeds and rows; ``sample(row, a, b)`` gives the observed (cex, dex) paths."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                x, y = sample(r, *prices(int(r["n"]), r["adjust_a"], r["adjust_b"], 0.0005, 0.0, int(r["seed"])))
                got = fit_paths(x, y)
                out.append({**r, "rows": len(x), "speed_a": got[0] if got else None, "speed_b": got[1] if got else None})
            yield pd.DataFrame(out, columns=[*f.columns, "rows", "speed_a", "speed_b"])

    fit = params.repartition("seed", "adjust_a", "adjust_b").mapInPandas(run, fields + ", rows long, speed_a double, speed_b double")
    return fit.withColumns({"weight_a": weight(F.col("speed_a"), F.col("speed_b")), "leads": leads(F.col("speed_a"), F.col("speed_b"))})


def calibration(spark: SparkSession, speeds: list[tuple[float, float]], seeds: int, n: int = 4000) -> DataFrame:
    """Recovered weight against the true one, b / (a + b), for each pair of speeds and seed."""
    grid = spark.createDataFrame(speeds, "adjust_a double, adjust_b double").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("n", F.lit(n))
    fit = _runs(grid, "", lambda r, a, b: (a, b)).withColumn("truth", F.col("adjust_b") / (F.col("adjust_a") + F.col("adjust_b")))
    return fit.select("adjust_a", "adjust_b", "truth", "seed", "weight_a", (F.col("weight_a") - F.col("truth")).alias("error"), (F.col("adjust_a") == F.col("adjust_b")).alias("even"))


def calibration_summary(runs: DataFrame, clear: float = 0.2) -> DataFrame:
    """Bias, scatter, and how often the leader is found, for clear and close truths; even runs aside."""
    gap = F.abs(F.col("truth") - 0.5)
    right = ((F.col("weight_a") > 0.5) == (F.col("truth") > 0.5)).cast("double")
    odd = ~F.col("even")
    return runs.agg(F.avg("error").alias("bias"), F.min("error").alias("error_low"), F.max("error").alias("error_high"), F.count_if(odd & (gap >= clear)).alias("clear_runs"), F.avg(F.when(odd & (gap >= clear), right)).alias("clear_found"), F.count_if(odd & (gap < clear)).alias("close_runs"), F.avg(F.when(odd & (gap < clear), right)).alias("close_found"))


def staleness(spark: SparkSession, lengths: list[int], keeps: list[float], seeds: int, schemes: tuple[str, ...] = ("hold", "drop"), shift: int = 5000) -> DataFrame:
    """Fits where the pool is the true leader and is seen sparsely: held values stand in, or rows go.

    The first simulated venue is the pool; the fit is (cex, pool).  leads says that cex seems to
    lead, which is false."""
    grid = spark.createDataFrame([(s, n, k) for s in schemes for n in lengths for k in keeps], "scheme string, n int, keep double")
    grid = grid.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumns({"adjust_a": F.lit(0.0), "adjust_b": F.lit(0.4)})

    def sample(r: dict, pool: np.ndarray, cex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.random.default_rng(int(r["seed"]) + shift).random(len(pool)) < r["keep"]
        kept[0] = True
        if r["scheme"] == "drop":
            return cex[kept], pool[kept]
        return cex, pool[np.maximum.accumulate(np.where(kept, np.arange(len(pool)), 0))]

    return _runs(grid, "", sample).drop("adjust_a", "adjust_b")


def false_lead_curve(runs: DataFrame) -> DataFrame:
    """Share of runs in which cex seems to lead, by scheme and keep."""
    return runs.where("leads is not null").groupBy("scheme", "n", "keep").agg(F.avg(F.col("leads").cast("double")).alias("false_lead"), F.count("*").alias("runs"))
