"""python -m tickloom STUDY RAW OUT [WINDOW ...]: runs a study over RAW/<window>/*.csv and writes OUT/<study> as CSV.

RAW/<window> has one CSV of paired minutes (ts, cex, dex) for each symbol, coverage.csv, and maybe
universe.csv.  Without windows all folders of RAW are taken.  calibration and staleness simulate and
need no input (RAW may be -).
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bars as B
from .operators import estimators as E
from .operators import relation as R
from .operators import resample as S
from .operators import simulate as M
from .operators.bars import KEYS
from .plans import studies as Q
from .schema import COVERAGE, MIN_OVERLAP, UNIVERSE
from .sources import tables as T

def series(spark: SparkSession, raw: str, windows: list[str]) -> DataFrame:
    return reduce(DataFrame.union, [T.read_series_csv(spark, f"{raw}/{w}", w) for w in windows])


def tables(spark: SparkSession, raw: str, windows: list[str], name: str, schema: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [T.read_csv(spark, f"{raw}/{w}/{name}.csv", schema).withColumn("window", F.lit(w)) for w in windows])


def ranked(paired: DataFrame) -> DataFrame:
    return Q.enough(paired)


def permutations(spark: SparkSession, volumes: DataFrame, windows: list[str], draws: int = S.PERMUTATIONS) -> DataFrame:
    """Permutation p-values of activity against ratio, a window at a time (each a small table)."""
    from .functions.numeric import average_rank

    parts = []
    for w in windows:
        v = volumes.where(F.col("window") == w).withColumn("ratio", B.premium_ratio(F.col("cex_vol"), F.col("dex_vol")))
        r = v.select(F.col("symbol").alias("id"), average_rank("paired_min").alias("rx"), average_rank("ratio").alias("ry"))
        parts.append(S.permutation_test(r, draws).select(F.lit(w).alias("window"), "p_value"))
    return reduce(DataFrame.union, parts)


def run(spark: SparkSession, study: str, raw: str, windows: list[str]) -> tuple[DataFrame, list[str]]:
    """(result, its sort keys)."""
    if study == "calibration":
        return M.calibration(spark, M.SPEEDS, M.SEEDS), ["adjust_a", "adjust_b", "seed"]
    if study == "staleness":
        return M.staleness(spark, [4000], M.KEEPS, M.RUNS), ["scheme", "keep", "seed"]
    if study == "staleness_matched":
        return M.staleness(spark, *M.MATCHED, M.RUNS, schemes=("drop",), shift=7000), ["n", "keep", "seed"]
    paired = series(spark, raw, windows)
    cover = lambda: tables(spark, raw, windows, "coverage", COVERAGE)
    if study == "robustness":
        return Q.robustness(paired, cover()), ["window", "paired_minutes", "symbol"]
    if study == "vector":
        return E.vector_check(E.log_prices(ranked(paired))), KEYS
    if study == "lags":
        return Q.lag_sweep(ranked(paired)), [*KEYS, "lags"]
    if study == "grid":
        return Q.grid_sweep(ranked(paired), 300), [*KEYS, "grid"]
    if study == "sessions":
        return Q.sessions(ranked(paired)), KEYS
    if study == "threshold":
        return Q.threshold(paired), ["window", "minutes", "symbol"]
    if study == "alignment":
        return Q.alignment(ranked(paired), 60), KEYS
    if study == "spacing":
        return B.spacing(paired), KEYS
    if study == "dependence":
        return Q.dependence(ranked(paired), 60, MIN_OVERLAP), ["window", "leg"]
    if study == "leadership":
        return R.leadership_across_windows(E.vecm_fit(E.log_prices(ranked(paired))).select("window", "symbol", "w_a"), windows), ["symbol"]
    if study == "relation":
        u = tables(spark, raw, windows, "universe", UNIVERSE)
        v = u.join(cover().select(*KEYS, "paired_minutes"), KEYS).select(*KEYS, F.col("paired_minutes").alias("paired_min"), F.col("cex_volume_24h").alias("cex_vol"), F.col("dex_volume_24h").alias("dex_vol"), F.col("dex_liquidity").alias("liquidity"))
        return R.ratio_relation(v).join(permutations(spark, v, windows), "window"), ["window"]
    raise SystemExit(f"no study named {study}\n\n{__doc__}")


def main(args: list[str]) -> None:
    if len(args) < 3:
        raise SystemExit(__doc__)
    study, raw, out, *windows = args
    spark = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not windows and raw != "-":
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "coverage.csv").option("recursiveFileLookup", True).load(raw)
        windows = sorted(r[0] for r in listed.select(F.regexp_extract("path", r"([^/]+)/coverage\.csv$", 1)).collect())
    result, keys = run(spark, study, raw, windows)
    T.write_csv(result, f"{out}/{study}", keys, 10)


if __name__ == "__main__":
    main(sys.argv[1:])
