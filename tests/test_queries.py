import os

import numpy as np
import pytest
from compare import DATA, of_duckdb, of_spark, views
from test_text_sources import settled

from tickloom.operators import simulate
from tickloom.plans import oracle, queries, studies

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(DATA)


def test_every_statement_has_its_query():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, con, name):
    assert of_spark(queries.queries()[name](spark, DATA)) == of_duckdb(con, SQL[name])


# ------------------------------------------------------------------ queries that SQL cannot state


def test_all_others_are_tested_here():
    assert set(queries.queries()) - set(SQL) == {"simulated_pair", "wrap", "sim_calibration", "calibration_summary", "sim_staleness", "sim_staleness_matched", "stream_pairs", "checks_table"}


def test_simulated_pair_is_the_simulator(spark):
    got = queries.simulated_pair(spark, DATA).toPandas()
    a, b = simulate.prices(500, 0.0, 0.4, 0.0005, 0.0, 0)
    assert got.iloc[:, 0].tolist() == list(range(500)) and np.array_equal(got.iloc[:, 1], a) and np.array_equal(got.iloc[:, 2], b)


def test_wrap_equals_textwrap(spark, con):
    got = {r["doc_id"]: r["wrapped"] for r in queries.wrap(spark, DATA).collect()}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got.keys() == texts.keys() and all(got[i] == (None if t is None else settled(t)) for i, t in texts.items())


def test_staleness_equals_the_published_curve(spark):
    got = {(r["scheme"], r["keep"]): r["false_lead"] for r in queries.sim_staleness(spark, DATA).collect()}
    # FIXED VALUES: published false-lead rates of 40 runs each, by share kept
    drop = {0.05: 0.375, 0.1: 0.2, 0.2: 0.175, 0.3: 0.125, 0.45: 0.025, 0.6: 0.0, 0.8: 0.0, 1.0: 0.0}
    hold = {0.05: 1.0, 0.1: 1.0, 0.2: 1.0, 0.3: 1.0, 0.45: 1.0, 0.6: 1.0, 0.8: 0.95, 1.0: 0.0}
    assert got == {("drop", k): v for k, v in drop.items()} | {("hold", k): v for k, v in hold.items()}


def test_calibration_runs_and_their_summary(spark):
    runs = queries.sim_calibration(spark, DATA).toPandas()
    assert len(runs) == len(simulate.SPEEDS) * simulate.SEEDS
    for a, b, seed in [(*simulate.SPEEDS[0], 0), (*simulate.SPEEDS[-1], simulate.SEEDS - 1)]:
        x, y = simulate.fit_paths(*simulate.prices(4000, a, b, 0.0005, 0.0, seed))[:2]
        mine = runs[(runs["adjust_a"] == a) & (runs["adjust_b"] == b) & (runs["seed"] == seed)].iloc[0]
        assert mine["weight_a"] == pytest.approx(-y / (x - y)) and mine["truth"] == pytest.approx(b / (a + b))
    s = queries.calibration_summary(spark, DATA).first()
    odd, right = runs[~runs["even"]], (runs["weight_a"] > 0.5) == (runs["truth"] > 0.5)
    clear = (odd["truth"] - 0.5).abs() >= 0.2
    assert s["bias"] == pytest.approx(runs["error"].mean()) and (s["clear_runs"], s["close_runs"]) == (clear.sum(), (~clear).sum())
    assert s["clear_found"] == pytest.approx(right[odd.index][clear].mean()) and s["close_found"] == pytest.approx(right[odd.index][~clear].mean())


def test_matched_staleness_has_every_run(spark):
    got = queries.sim_staleness_matched(spark, DATA).toPandas()
    lengths, keeps = simulate.MATCHED
    assert len(got) == len(lengths) * len(keeps) * simulate.RUNS == len(got.drop_duplicates(["n", "keep", "seed"]))
    assert (got["fitted"] == got["w_cex"].notna()).all() and (got["rows"] <= got["n"]).all()


def test_streamed_pairs_are_the_batch_pairs_but_for_open_buckets(spark):
    got = {(r["symbol"], r["ts"]): (r["cex"], r["dex"]) for r in queries.stream_pairs(spark, DATA).collect()}
    want = {(r["symbol"], r["ts"]): (r["cex"], r["dex"]) for r in queries.paired_bars(spark, DATA).collect()}
    last = max(ts for _, ts in want)
    assert got and all(want[k] == v for k, v in got.items())
    assert all(ts >= last - 2 * 3600 for _, ts in want.keys() - got.keys())


def test_checks_table_reads_its_studies(spark):
    make = spark.createDataFrame
    fits = make([("w", "A", 0.9, 0.4, True), ("w", "B", 0.2, 0.8, True), ("w", "C", None, 0.7, None)], "window string, symbol string, w_realigned double, w_as_collected double, leads boolean")
    robust = make([(True, True, 0.25), (False, True, 0.75)], "stationary boolean, agree boolean, lead_share double")
    vector = make([(True,), (False,), (True,)], "same_leader boolean")
    risk = make([(0.125,), (0.5,)], "false_lead_drop double")
    spaced = make([(1.0, 0.1), (2.0, 0.2), (3.0, 0.9)], "mean_step double, w_a double")
    sweep = make([("A", True), ("A", False), ("B", True), ("B", True), ("C", None)], "symbol string, leads boolean")
    dep = make([("spread", 0.5), ("cex", 0.25), ("dex", 0.1)], "leg string, median double")
    below = make([(0.75,), (0.25,), (None,)], "w_a double")
    across = make([(2, True), (1, False), (0, False)], "windows_ranked int, led_every_window boolean")
    got = studies.checks_table(fits, robust, vector, risk, spaced, sweep, sweep, dep, below, across).orderBy("at").collect()
    assert [r["result"] for r in got] == [
        "first venue ahead in 1 of 2, against 1 as collected", "stationary in 1 of 2", "same leader in 2 of 3", "same direction in 2 of 2", "first venue ahead in 25% to 75% of resamples", "error 13% to 50% at these fill rates",
        "rank correlation +1.00 over 3 series", "leader changes in 1 of 2", "same leader in 1 of 2", "0.50, against 0.25 on the first venue's legs", "1 of 2 lean the same way, median 0.50, 1 too thin to fit", "led in every window ranked, 1 of 2 tokens",
    ]
    assert [r["tone"] for r in got] == ["", *["pass"] * 9, "", "pass"]


def test_checks_table_has_its_rows(spark):
    got = queries.checks_table(spark, DATA).collect()
    assert sorted(r["at"] for r in got) == list(range(12)) and all(r["question"] and r["method"] and r["result"] for r in got)
