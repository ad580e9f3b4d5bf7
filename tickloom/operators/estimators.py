"""Error-correction fits as distributed Gram matrices.

A fit needs only the sums of products of its columns.  They are one partial aggregate per (window,
symbol), so a group may have any length; the small dense solve then runs once per group, in Arrow
batches.  All lags come from one window, sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import leads, weight
from ..schema import ADF_CRITICAL, BETA_TOLERANCE, LAGS, adf_minimum, vecm_minimum
from .bars import KEYS

#: Rank is counted down to this share of the largest singular value.
RCOND = 1e-13


def _window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def log_prices(paired: DataFrame) -> DataFrame:
    """Adds a = log cex and b = log dex; rows without two positive prices go."""
    return paired.where((F.col("cex") > 0) & (F.col("dex") > 0)).withColumns({"a": F.log("cex"), "b": F.log("dex")})


def vecm_design(logs: DataFrame, lags: int = LAGS, keys: list[str] = KEYS, beta: Column | None = None) -> DataFrame:
    """Columns s (spread one row before), da1.., db1.. (changes before), ya, yb (changes now) and n,
    the group's rows.  The first lags + 1 rows of a group go; lags count rows, not time."""
    w, part = _window(keys), Window.partitionBy(*keys)
    slope = F.lit(1.0) if beta is None else beta
    la = [F.lag("a", i).over(w) if i else F.col("a") for i in range(lags + 2)]
    lb = [F.lag("b", i).over(w) if i else F.col("b") for i in range(lags + 2)]
    cols = {"s": la[1] - slope * lb[1], "ya": la[0] - la[1], "yb": lb[0] - lb[1]}
    for i in range(1, lags + 1):
        cols |= {f"da{i}": la[i] - la[i + 1], f"db{i}": lb[i] - lb[i + 1]}
    out = logs.withColumns(cols | {"_full": la[lags + 1], "n": F.count(F.lit(1)).over(part)})
    return out.where(F.col("_full").isNotNull()).drop("_full")


def vecm_columns(lags: int) -> list[str]:
    return ["one", "s", *[f"da{i}" for i in range(1, lags + 1)], *[f"db{i}" for i in range(1, lags + 1)], "ya", "yb"]


def gram(frame: DataFrame, columns: list[str], keys: list[str], *more: Column) -> DataFrame:
    """Upper triangle of the sums of products of columns ('one' is the constant), row by row, as ``gram``."""
    col = lambda c: F.lit(1.0) if c == "one" else F.col(c)
    sums = [F.sum(col(x) * col(y)) for i, x in enumerate(columns) for y in columns[i:]]
    return frame.groupBy(*keys).agg(F.array(*sums).alias("gram"), F.count("*").alias("rows"), *more)


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    """Full symmetric matrices from rows of upper triangles."""
    full = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = flat
    full[:, j, i] = flat
    return full


def solve(full: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residual products) of the last ``targets`` columns on the others: columns are
    scaled to unit length first; where the matrix lacks rank, the shortest solution holds."""
    x = full[:, :-targets, :-targets]
    xy = full[:, :-targets, -targets:]
    yy = full[:, -targets:, -targets:]
    scale = np.sqrt(np.maximum(np.diagonal(x, axis1=1, axis2=2), 0.0))
    scale[scale == 0] = 1.0
    unit = x / scale[:, :, None] / scale[:, None, :]
    right = xy / scale[:, :, None]
    try:
        with np.errstate(all="ignore"):
            good = np.linalg.cond(unit) < 1 / RCOND
        b = np.zeros_like(right)
        if good.any():
            b[good] = np.linalg.solve(unit[good], right[good])
        if (~good).any():
            b[~good] = np.linalg.pinv(unit[~good], rcond=RCOND, hermitian=True) @ right[~good]
    except np.linalg.LinAlgError:
        b = np.linalg.pinv(unit, rcond=RCOND, hermitian=True) @ right
    b = b / scale[:, :, None]
    left = yy - np.transpose(b, (0, 2, 1)) @ xy
    return b, left


def _solved(rows: DataFrame, k: int, fields: str, values) -> DataFrame:
    """Adds what ``values(gram matrices, frame)`` returns for batches of one-row groups."""
    keep = [f for f in rows.schema.fields if f.name != "gram"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                full = unpack(np.array(f["gram"].tolist(), dtype=float).reshape(len(f), -1), k)
                yield f.drop(columns="gram").assign(**values(full, f))

    return rows.mapInPandas(run, schema)


def vecm_fit(logs: DataFrame, lags: int = LAGS, keys: list[str] = KEYS, beta: Column | None = None) -> DataFrame:
    """(keys, minutes, rows, speed_a, speed_b, w_a, leads, omega_aa, omega_ab, omega_bb).

    Groups with fewer than 4 * lags + 20 rows are refused: they do not appear.  w_a is NULL where
    the speeds agree.  omega is the residual covariance with one degree of freedom."""
    design = vecm_design(logs, lags, keys, beta).where(F.col("n") >= vecm_minimum(lags))
    cols = vecm_columns(lags)

    def values(full: np.ndarray, f: pd.DataFrame) -> dict:
        b, left = solve(full, 2)
        rows = f["rows"].to_numpy(float)
        # residuals have mean zero: the constant is a regressor
        return {"speed_a": b[:, 1, 0], "speed_b": b[:, 1, 1], "omega_aa": left[:, 0, 0] / (rows - 1), "omega_ab": left[:, 0, 1] / (rows - 1), "omega_bb": left[:, 1, 1] / (rows - 1)}

    g = gram(design, cols, keys, F.max("n").alias("minutes"))
    fit = _solved(g, len(cols), "speed_a double, speed_b double, omega_aa double, omega_ab double, omega_bb double", values)
    return fit.withColumns({"w_a": weight(F.col("speed_a"), F.col("speed_b")), "leads": leads(F.col("speed_a"), F.col("speed_b"))})


def hasbrouck(fit: DataFrame) -> DataFrame:
    """Adds is_low, is_high and rho to a fit: information-share bounds of a over both orders of the
    two innovations, and their correlation (reported within +-0.999999)."""
    wa, wb = F.col("w_a"), 1 - F.col("w_a")
    va, vb, c = F.col("omega_aa"), F.col("omega_bb"), F.col("omega_ab")
    total = wa * wa * va + 2 * wa * wb * c + wb * wb * vb
    ok = (va > 0) & (vb > 0) & (total > 0)
    rho2 = F.least(F.lit(1.0), c * c / (va * vb))
    first = (wa * F.sqrt(va) + wb * c / F.sqrt(va)) ** 2 / total
    last = wa * wa * va * (1 - rho2) / total
    rho = c / F.sqrt(va * vb)
    only = lambda x: F.when(ok, x)
    return fit.withColumns({"is_low": only(F.least(first, last)), "is_high": only(F.greatest(first, last)), "rho": F.when((va > 0) & (vb > 0), F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), rho)))})


def adf(series: DataFrame, x: str = "z", lags: int = LAGS, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, adf, half_life, stationary): Dickey-Fuller t with lagged changes, no constant and no trend.
    The caller takes the mean out.  Half-life counts rows, infinite where there is no decay.
    Groups with fewer than lags + 20 rows do not appear."""
    w, part = _window(keys), Window.partitionBy(*keys)
    z = [F.lag(x, i).over(w) if i else F.col(x) for i in range(lags + 2)]
    cols = {"z1": z[1], "dz": z[0] - z[1]} | {f"d{i}": z[i] - z[i + 1] for i in range(1, lags + 1)}
    design = series.withColumns(cols | {"n": F.count(F.lit(1)).over(part), "_full": z[lags + 1]}).where(F.col("_full").isNotNull() & (F.col("n") >= adf_minimum(lags)))
    names = ["z1", *[f"d{i}" for i in range(1, lags + 1)], "dz"]

    def values(full: np.ndarray, f: pd.DataFrame) -> dict:
        b, left = solve(full, 1)
        rows, k = f["rows"].to_numpy(float), lags + 1
        inverse = np.linalg.pinv(full[:, :k, :k], rcond=1e-15, hermitian=True)[:, 0, 0]
        with np.errstate(all="ignore"):
            t = b[:, 0, 0] / np.sqrt(left[:, 0, 0] / (rows - k) * inverse)
        return {"gamma": b[:, 0, 0], "adf": t}

    fit = _solved(gram(design, names, keys, F.max("n").alias("n")), len(names), "gamma double, adf double", values)
    decay = 1 + F.col("gamma")
    half = F.when((decay > 0) & (decay < 1), F.log(F.lit(0.5)) / F.log(decay)).otherwise(F.lit(float("inf")))
    return fit.withColumns({"half_life": half, "stationary": F.col("adf") < ADF_CRITICAL[0.05]}).drop("gamma", "rows")


def demeaned(logs: DataFrame, spread: Column, out: str = "z", keys: list[str] = KEYS) -> DataFrame:
    s = logs.withColumn("_s", spread)
    return s.withColumn(out, F.col("_s") - F.avg("_s").over(Window.partitionBy(*keys))).drop("_s")


def cointegrating_vector(logs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, beta, beta_se, intercept, low, high): slope of a on b, and the bracket that errors in both
    allow, from beta to one over the reverse slope (infinite where that is 0)."""
    n = F.count("*")
    out = logs.groupBy(*keys).agg(F.regr_slope("a", "b").alias("beta"), F.regr_intercept("a", "b").alias("intercept"), F.regr_slope("b", "a").alias("reverse"), n.alias("_n"), F.regr_sxx("a", "b").alias("_sxx"), F.regr_syy("a", "b").alias("_syy"), F.regr_sxy("a", "b").alias("_sxy"))
    sse = F.greatest(F.lit(0.0), F.col("_syy") - F.col("beta") * F.col("_sxy"))
    far = F.coalesce(F.try_divide(F.lit(1.0), F.col("reverse")), F.lit(float("inf")))
    se = F.when(F.col("_n") > 2, F.sqrt(F.try_divide(sse, (F.col("_n") - 2) * F.col("_sxx"))))
    return out.select(*keys, "beta", se.alias("beta_se"), "intercept", F.least("beta", far).alias("bracket_low"), F.greatest("beta", far).alias("bracket_high"))


def vector_check(logs: DataFrame, lags: int = LAGS) -> DataFrame:
    """The imposed vector (1, -1) against the fitted one: slopes, bracket, both unit-root tests, both weights."""
    vec = cointegrating_vector(logs)
    with_beta = logs.join(vec.select(*KEYS, "beta"), KEYS)
    plain = vecm_fit(logs, lags).select(*KEYS, F.col("w_a").alias("w_imposed"), F.col("leads").alias("l0"))
    fitted = vecm_fit(with_beta, lags, beta=F.col("beta")).select(*KEYS, F.col("w_a").alias("w_fitted"), F.col("leads").alias("l1"))
    adf0 = adf(demeaned(logs, F.col("a") - F.col("b")), lags=lags).select(*KEYS, F.col("adf").alias("adf_imposed"))
    adf1 = adf(demeaned(with_beta, F.col("a") - F.col("beta") * F.col("b")), lags=lags).select(*KEYS, F.col("adf").alias("adf_fitted"))
    out = vec.join(adf0, KEYS).join(adf1, KEYS).join(plain, KEYS).join(fitted, KEYS)
    return out.select(*KEYS, "beta", "beta_se", "bracket_low", "bracket_high", F.lit(1.0).between(F.col("bracket_low"), F.col("bracket_high")).alias("one_bracketed"), (F.abs(F.col("beta") - 1) <= BETA_TOLERANCE).alias("beta_near_one"), "adf_imposed", "adf_fitted", "w_imposed", "w_fitted", (F.col("l0") == F.col("l1")).alias("same_leader"))
