import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import numeric as N
from tickloom.operators import bars as B
from tickloom.operators import estimators as E
from tickloom.operators import relation as R
from tickloom.operators import resample as S
from tickloom.operators import simulate as M
from tickloom.plans import queries
from tickloom.plans import studies as Q
from tickloom.schema import PAIRED


def frame(spark, ts, cex, dex, symbol="S", window="w"):
    return spark.createDataFrame([(window, symbol, int(t), float(a), float(b)) for t, a, b in zip(ts, cex, dex, strict=True)], PAIRED)


def simulated(spark, n=1500, a=0.0, b=0.4, seed=0, symbol="S"):
    x, y = M.prices(n, a, b, 0.0005, 0.0, seed)
    return frame(spark, range(0, 60 * n, 60), x, y, symbol)


def test_session_mask(spark):
    stamps = ["2026-07-29 13:29", "2026-07-29 13:30", "2026-07-29 19:59", "2026-07-29 20:00", "2026-08-01 15:00", "2026-08-02 15:00"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string").withColumn("ts", F.unix_timestamp("s", "yyyy-MM-dd HH:mm"))
    assert [r[0] for r in df.orderBy("i").select(B.in_session(F.col("ts"))).collect()] == [False, True, True, False, False, False]


def test_gap_aware_changes(spark):
    df = frame(spark, [0, 60, 120, 600, 660], [1, 2, 3, 99, 100], [1] * 5)
    assert [r["change"] for r in B.step_changes(df, "cex").orderBy("ts").collect()] == [1, 1, 1]


def test_realign_contiguous(spark):
    df = frame(spark, range(0, 360, 60), [100, 101, 103, 106, 110, 115], [101, 103, 106, 110, 115, 121])
    got = B.realign(df).collect()
    assert len(got) == 5 and all(r["cex"] == r["dex"] for r in got)


def test_realign_drops_gaps(spark):
    got = B.realign(frame(spark, [0, 60, 300, 360], [1, 2, 3, 4], [9, 9, 9, 9])).orderBy("ts").collect()
    assert [(r["ts"], r["cex"]) for r in got] == [(0, 2), (300, 4)]


def test_average_ranks_and_spearman(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "x double")
    assert sorted(r[0] for r in df.select(N.average_rank("x")).collect()) == [1.0, 2.0, 3.5, 3.5]
    two = spark.createDataFrame([(float(i), v) for i, v in enumerate([1.0, 10.0, 100.0, 1e3, 1e4, 1e6])], "x double, y double")
    assert R.spearman(two, "x", "y").first()["rho"] == pytest.approx(1.0)
    down = two.withColumn("y", -F.col("y"))
    assert R.spearman(down, "x", "y").first()["rho"] == pytest.approx(-1.0)
    flat = two.withColumn("y", F.lit(1.0))
    assert R.spearman(flat, "x", "y").first()["rho"] is None


@pytest.mark.parametrize(("led", "total", "p"), [(9, 9, 0.00390625), (8, 9, 0.0390625), (5, 9, 1.0), (7, 7, 0.015625), (0, 6, 0.03125), (0, 0, None), (3, -1, None)])
def test_sign_test(spark, led, total, p):
    got = spark.createDataFrame([(led, total)], "l int, t int").select(N.sign_test(F.col("l"), F.col("t"))).first()[0]
    assert got == (None if p is None else pytest.approx(p))


def test_effective_count(spark):
    df = spark.createDataFrame([(7.0, 0.0), (7.0, 1.0), (7.0, -0.5)], "n double, r double")
    assert [r[0] for r in df.select(N.effective_count(F.col("n"), F.col("r"))).collect()] == [7.0, 1.0, 7.0]


def test_known_leader_and_swap(spark):
    df = simulated(spark, 4000)
    got = E.vecm_fit(E.log_prices(df)).first()
    assert got["w_a"] > 0.9 and got["leads"] and got["minutes"] == 4000 and got["rows"] == 3994
    assert got["w_a"] == pytest.approx(1.1157586809, abs=1e-8)
    back = E.vecm_fit(E.log_prices(df.select("window", "symbol", "ts", F.col("dex").alias("cex"), F.col("cex").alias("dex")))).first()
    assert back["w_a"] == pytest.approx(1 - got["w_a"], abs=1e-6)


def test_short_samples_are_refused(spark):
    assert E.vecm_fit(E.log_prices(simulated(spark, 30))).count() == 0
    assert Q.threshold(simulated(spark, 30)).first()["w_a"] is None


def test_row_order_and_partitions_do_not_matter(spark):
    df = simulated(spark, 600)
    a = E.vecm_fit(E.log_prices(df)).first()["w_a"]
    assert E.vecm_fit(E.log_prices(df.repartition(7, "ts"))).first()["w_a"] == pytest.approx(a, abs=1e-10)


def test_unit_beta_equals_imposed(spark):
    logs = E.log_prices(simulated(spark, 800))
    one = E.vecm_fit(logs.withColumn("beta", F.lit(1.0)), beta=F.col("beta")).first()
    assert one["w_a"] == pytest.approx(E.vecm_fit(logs).first()["w_a"], abs=1e-9)


def test_constant_series_has_no_weight(spark):
    got = E.vecm_fit(E.log_prices(frame(spark, range(0, 6000, 60), [5.0] * 100, [5.0] * 100))).first()
    assert got["w_a"] is None and abs(got["speed_a"]) < 1e-9


def test_adf_separates_reversion_from_a_walk(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=600)
    x = [0.0]
    for v in e[1:]:
        x.append(0.8 * x[-1] + v)
    walks = {f"w{k}": np.cumsum(np.random.default_rng(100 + k).normal(size=600)) for k in range(20)}
    rows = [("w", s, i * 60, float(v)) for s, z in {"ar": x, **walks}.items() for i, v in enumerate(z)]
    df = E.demeaned(spark.createDataFrame(rows, "window string, symbol string, ts long, v double"), F.col("v"))
    got = {r["symbol"]: r for r in E.adf(df).collect()}
    assert got["ar"]["stationary"] and 2.0 < got["ar"]["half_life"] < 4.5
    assert sum(got[w]["stationary"] for w in walks) <= 10 and all(got["ar"]["adf"] < got[w]["adf"] for w in walks)


def test_lag_profile_finds_the_shift(spark):
    steps = np.random.default_rng(3).normal(size=400) * 0.01
    p = np.exp(np.cumsum(steps)) * 100
    got = B.lag_profile(frame(spark, range(0, 60 * 399, 60), p[:-1], p[1:])).first()
    assert got["best_lag"] == 1 and got["corr_at_best"] == pytest.approx(1.0) and abs(got["corr_at_zero"]) < 0.2


def test_lag_profile_of_a_flat_pair_is_null(spark):
    got = B.lag_profile(frame(spark, [0, 60, 120], [1, 1, 1], [2, 2, 2])).first()
    assert got["best_lag"] is None and got["corr_at_best"] is None


def test_bootstrap_knows_leader_and_follower(spark):
    df = simulated(spark, 4000, symbol="lead").union(simulated(spark, 4000, 0.4, 0.0, symbol="follow"))
    got = {r["symbol"]: r for r in S.bootstrap_summary(S.bootstrap_fits(E.log_prices(df), 60)).collect()}
    assert got["lead"]["lead_share"] > 0.9 and got["lead"]["speeds_separated"] and got["follow"]["lead_share"] < 0.1


def test_coverage_of_one_pair(spark):
    rows = [("w", "S", v, t, 1.0) for v, ts in (("a", [0, 60, 120, 300]), ("b", [60, 120, 240, 300, 360])) for t in ts]
    got = B.coverage(spark.createDataFrame(rows, "window string, symbol string, venue string, ts long, close double"), "a", "b").first()
    assert (got["cex_minutes"], got["dex_minutes"], got["window_minutes"], got["paired_minutes"]) == (3, 4, 5, 3)
    assert (got["median_gap_min"], got["max_gap_min"], got["consecutive_share"], got["fill_rate"]) == (2, 3, 0.5, 0.6)


def test_first_row_counts_as_a_move(spark):
    got = B.moves(frame(spark, [0, 60, 120], [1, 1, 2], [5, 5, 5])).first()
    assert (got["cex_moves"], got["dex_moves"]) == (2, 1)


def test_resample_takes_last_known_of_each_side(spark):
    df = spark.createDataFrame([("w", "S", 0, 1.0, 2.0), ("w", "S", 60, None, 3.0), ("w", "S", 600, 4.0, None)], PAIRED)
    got = B.resample(df, 300).orderBy("ts").collect()
    assert [(r["ts"], r["cex"], r["dex"]) for r in got] == [(0, 1.0, 3.0), (600, 4.0, None)]


def test_thinning_keeps_the_first_row(spark):
    df = frame(spark, range(0, 6000, 60), range(1, 101), range(1, 101))
    drop, hold = B.thin(df, 0.0, 1, hold=False).collect(), B.thin(df, 0.0, 1, hold=True).collect()
    assert [r["ts"] for r in drop] == [0] and len(hold) == 100 and {r["dex"] for r in hold} == {1.0}


def test_dependence_counts_pairs_without_overlap(spark):
    df = simulated(spark, 100, symbol="A").union(simulated(spark, 100, seed=1, symbol="B"))
    far = simulated(spark, 50, seed=2, symbol="C").withColumn("ts", F.col("ts") + 10**7)
    got = Q.dependence(df.union(far), 60, 60).where("leg = 'cex'").first()
    assert (got["token_pairs"], got["usable_pairs"], got["pairs_below_floor"], got["median_overlap"]) == (3, 1, 2, 0)


def test_groups_bucket(spark):
    u = spark.createDataFrame([("A", 100, 10), ("B", 100, 0), ("C", 5, 5), ("D", 1, 1)], "symbol string, cex_volume_24h long, dex_volume_24h long")
    m = spark.createDataFrame([("A", 3), ("B", 200), ("C", 50)], "symbol string, paired_min long")
    got = {r["symbol"]: (r["group"], r["ratio"]) for r in R.build_groups(u, m, F.col("symbol").isin("B")).collect()}
    assert got == {"A": ("dead", 10.0), "B": ("ranked", 100.0), "C": ("thin", 1.0), "D": ("thin", 1.0)}


def test_leadership_across_windows(spark):
    w = spark.createDataFrame([("x", "A", 0.9), ("y", "A", 0.6), ("x", "B", 0.4)], "window string, symbol string, w_a double")
    got = {r["symbol"]: r for r in R.leadership_across_windows(w, ["x", "y"]).collect()}
    assert got["A"]["led_every_window"] and got["A"]["spread_across_windows"] == pytest.approx(0.3)
    assert not got["B"]["led_every_window"] and got["B"]["y"] is None and got["B"]["spread_across_windows"] is None


def test_interpolation_is_clamped(spark):
    curve = spark.createDataFrame([(0.1, 1.0), (0.2, 3.0)], "k double, v double")
    got = N.interpolate(spark.createDataFrame([(0.0,), (0.15,), (0.2,), (9.0,)], "x double"), curve, "k", "v", "x", "y").orderBy("x").collect()
    assert [r["y"] for r in got] == pytest.approx([1.0, 2.0, 3.0, 3.0])


def test_strict_classes(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.3,), (0.29,), (None,)], "w double")
    assert [r[0] for r in df.select(N.strict_class(F.col("w"))).collect()] == ["cex", "unclassified", "unclassified", "dex", None]


def test_permutation_p_of_a_perfect_rank(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(12)], "id int, rx double, ry double")
    got = S.permutation_test(df, 200).first()
    assert got["rho"] == pytest.approx(1.0) and got["p_value"] < 0.02 and got["draws"] == 200


def test_sparse_sampling_misleads_when_held(spark):
    runs = M.staleness(spark, [4000], [0.3], 12)
    got = {r["scheme"]: r for r in M.false_lead_curve(runs).collect()}
    assert got["hold"]["false_lead"] * 12 >= 10 and got["drop"]["false_lead"] * 12 <= 4


def test_queries_simulate_and_resample_in_full(spark, monkeypatch):
    every = queries.queries()
    assert every["sim_calibration"](spark, "").count() == 96
    got = every["calibration_summary"](spark, "").first()
    assert (got["clear_runs"], got["close_runs"]) == (60, 12)
    assert {(r["scheme"], r["runs"]) for r in every["sim_staleness"](spark, "").collect()} == {("hold", 40), ("drop", 40)}
    assert every["sim_staleness"](spark, "").count() == 16
    matched = {(r["n"], r["keep"], r["seed"]): r for r in every["sim_staleness_matched"](spark, "").collect()}
    assert len(matched) == 360 and matched[4000, 0.5, 0]["w_cex"] == pytest.approx(0.1368908299, abs=1e-6)
    assert not all(r["fitted"] for r in matched.values())
    assert all(r["fitted"] == (r["w_cex"] is not None) for r in matched.values())
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(d):
        assert every["perm_spearman"](spark, d).first()["draws"] == 20000
    monkeypatch.setattr(queries, "logs", lambda spark, d: E.log_prices(simulated(spark, 600)))
    assert [r["draws"] for r in every["bootstrap_lead"](spark, d).collect()] == [400]


def test_simulator_as_a_table_function(spark):
    M.register(spark)
    got = spark.sql("SELECT * FROM simulate_pair(5, 0.0D, 0.4D, 0.0005D, 0.0D, 0)").orderBy("t").collect()
    a, b = M.prices(5, 0.0, 0.4, 0.0005, 0.0, 0)
    assert [r["a"] for r in got] == pytest.approx(list(a)) and got[0]["b"] == 1.0 and not math.isnan(got[4]["b"]) and b[4] == pytest.approx(got[4]["b"])
