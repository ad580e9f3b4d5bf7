"""Queries over the driver's tables.  Events stand in for ticks: symbol = event_type, venue = user_id mod 2,
hourly bars; a window is ten days where more than one is wanted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import bars as B
from ..operators import claims as C
from ..operators import estimators as E
from ..operators import relation as R
from ..operators import resample as S
from ..operators import simulate as M
from ..sources import payloads as P
from ..sources import tables as T
from . import studies as Q

HOUR = 3600
ORIGIN, SPAN = 1704067200, 10 * 86400
tidy = N.tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    at = N.epoch("ts")
    window = F.concat(F.lit("w"), F.floor((at - ORIGIN) / SPAN)) if split else F.lit("all")
    return table(spark, sf_dir, "events").select(window.alias("window"), F.col("event_type").alias("symbol"), (F.col("user_id") % 2).alias("venue"), at.alias("at"), F.col("ts").alias("t0"), F.col("event_id").alias("seq"), "value")


def bars(spark: SparkSession, sf_dir: str, width: int = HOUR, split: bool = False) -> DataFrame:
    return B.bars(ticks(spark, sf_dir, split), width, order=("t0", "seq"))


def paired(spark: SparkSession, sf_dir: str, width: int = HOUR, split: bool = False) -> DataFrame:
    return B.pair_ticks(ticks(spark, sf_dir, split), width, 0, 1, order=("t0", "seq"))


def logs(spark: SparkSession, sf_dir: str, width: int = HOUR, split: bool = False) -> DataFrame:
    return E.log_prices(paired(spark, sf_dir, width, split))


def _speeds(fit: DataFrame, *more) -> DataFrame:
    return fit.select("window", "symbol", *more, "minutes", tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"), "leads")


# ------------------------------------------------------------------ bars


def bars_close(spark, d):
    return bars(spark, d).select("symbol", "venue", "ts", "close")


def paired_bars(spark, d):
    return paired(spark, d).select("symbol", "ts", "cex", "dex")


def coverage(spark, d):
    return B.coverage(bars(spark, d), 0, 1, HOUR).drop("window")


def spacing(spark, d):
    s = B.spacing(paired(spark, d), HOUR)
    return s.select("symbol", tidy(F.col("mean_step")).alias("mean_step"), tidy(F.col("median_step")).alias("median_step"), "paired_minutes")


def moves_premium(spark, d):
    return B.moves(paired(spark, d)).select("symbol", "minutes", "cex_moves", "dex_moves", tidy(F.col("mean_gap_pct")).alias("mean_gap_pct"))


def session_regimes(spark, d):
    r = B.regimes(paired(spark, d))
    return r.groupBy("symbol", "regime").agg(F.count("*").alias("minutes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def gap_changes(spark, d):
    long = logs(spark, d).withColumn("x", F.col("a"))
    return B.step_changes(long, "x", HOUR).select("symbol", "ts", tidy(F.col("change")).alias("change"))


def realign(spark, d):
    return B.realign(paired(spark, d), HOUR).select("symbol", "ts", "cex", "dex")


def dense_lag_profile(spark, d):
    p = B.lag_profile(paired(spark, d), 3, HOUR)
    one = p.select("symbol", "best_lag", F.explode("profile").alias("x"))
    return one.select("symbol", "best_lag", F.col("x.lag").alias("lag"), tidy(F.col("x.corr")).alias("corr"))


def grid_resample(spark, d):
    return B.resample(paired(spark, d), 5 * HOUR).select("symbol", "ts", "cex", "dex")


def forward_fill(spark, d):
    return B.fill_forward(B.dense(paired(spark, d), HOUR), "cex", "dex").select("symbol", "ts", "cex", "dex")


def thin_drop(spark, d):
    return B.thin(paired(spark, d), 0.3, 7, hold=False).select("symbol", "ts", "cex", "dex")


def thin_hold(spark, d):
    return B.thin(paired(spark, d), 0.3, 7, hold=True).select("symbol", "ts", "cex", "dex")


def orders_paired(spark, d):
    """Daily order prices by priority, customers' parity as the venue."""
    o = table(spark, d, "orders").where("o_totalprice > 0").select(F.lit("all").alias("window"), F.col("o_orderpriority").alias("symbol"), (F.col("o_custkey") % 2).alias("venue"), N.epoch("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return B.pair_ticks(o, 86400, 0, 1).groupBy("symbol").agg(F.count("*").alias("minutes"), tidy(F.avg(F.col("cex") / F.col("dex") - 1)).alias("premium"))


# ------------------------------------------------------------------ estimators


def vecm_fit(spark, d):
    return _speeds(E.vecm_fit(logs(spark, d))).drop("window")


def vecm_lag_sweep(spark, d):
    return _speeds(Q.lag_sweep(paired(spark, d)), "lags").drop("window")


def vecm_grid(spark, d):
    g = Q.grid_sweep(paired(spark, d), 5 * HOUR)
    return g.select("symbol", "grid", F.col("grid_rows").alias("rows"), tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"), "leads")


def vecm_sessions(spark, d):
    return Q.sessions(paired(spark, d)).select("symbol", "minutes_all", "minutes_shut", "leads_all", "leads_shut", tidy(F.col("w_all"), 4).alias("w_all"), tidy(F.col("w_shut"), 4).alias("w_shut"))


def vecm_threshold(spark, d):
    t = Q.threshold(paired(spark, d, split=True))
    return t.select("window", "symbol", "minutes", "kept", tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"), "leads")


def vecm_orders(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0").select(F.lit("all").alias("window"), F.col("o_orderpriority").alias("symbol"), (F.col("o_custkey") % 2).alias("venue"), N.epoch("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return _speeds(E.vecm_fit(E.log_prices(B.pair_ticks(o, 86400, 0, 1)))).drop("window")


def hasbrouck(spark, d):
    h = E.hasbrouck(E.vecm_fit(logs(spark, d)))
    return h.select("symbol", tidy(F.col("is_low"), 4).alias("is_low"), tidy(F.col("is_high"), 4).alias("is_high"), tidy(F.col("rho")).alias("rho"))


def adf_spread(spark, d):
    a = E.adf(E.demeaned(logs(spark, d), F.col("a") - F.col("b")))
    return a.select("symbol", "n", tidy(F.col("adf")).alias("adf"), tidy(F.when(F.col("half_life") < float("inf"), F.col("half_life")), 4).alias("half_life"), "stationary")


def vector_check(spark, d):
    v = E.vector_check(logs(spark, d))
    return v.select("symbol", *[tidy(F.col(c)).alias(c) for c in ("beta", "beta_se", "bracket_low", "adf_imposed", "adf_fitted")], "one_bracketed", "beta_near_one", "same_leader")


def alignment(spark, d):
    a = Q.alignment(paired(spark, d), HOUR)
    return a.select("symbol", "rows_as_collected", "rows_realigned", "leads_as_collected", "leads_realigned", tidy(F.col("spread_sd_bp_as_collected"), 4).alias("sd_as_collected"), tidy(F.col("spread_sd_bp_realigned"), 4).alias("sd_realigned"), "stationary_as_collected", "stationary_realigned", "best_lag", tidy(F.col("corr_at_zero")).alias("corr_at_zero"), tidy(F.col("corr_at_best")).alias("corr_at_best"))


def session_panel(spark, d):
    p = Q.session_panel(paired(spark, d))
    return p.select("symbol", "regime", "minutes", "cex_moves", "dex_moves", tidy(F.col("mean_gap_pct")).alias("mean_gap_pct"), tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"))


def venue_matrix(spark, d):
    at = N.epoch("ts")
    t = table(spark, d, "events").select(F.lit("all").alias("window"), F.lit("ALL").alias("symbol"), (F.col("user_id") % 4).alias("venue"), at.alias("at"), F.col("ts").alias("t0"), F.col("event_id").alias("seq"), "value")
    m = Q.venue_matrix(B.bars(t, HOUR, order=("t0", "seq")), [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
    return m.select("venue_a", "venue_b", "minutes", "moves_a", "moves_b", tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"))


def robustness(spark, d):
    """The flagship: every check in one plan."""
    b = bars(spark, d)
    r = Q.robustness(B.pair_up(b, 0, 1), B.coverage(b, 0, 1, HOUR))
    return r.select("symbol", "paired_minutes", "fill_rate", "consecutive_share", "median_gap_min", "max_gap_min", tidy(F.col("adf")).alias("adf"), "stationary", tidy(F.col("speed_a")).alias("speed_a"), tidy(F.col("speed_b")).alias("speed_b"), tidy(F.col("is_low"), 4).alias("is_low"), tidy(F.col("is_high"), 4).alias("is_high"), tidy(F.col("rho")).alias("rho"), tidy(F.col("lead_share")).alias("lead_share"), "speeds_separated", "agree", "verdict")


# ------------------------------------------------------------------ resampling


def bootstrap_lead(spark, d):
    s = S.bootstrap_summary(S.bootstrap_fits(logs(spark, d)))
    return s.select("symbol", "draws", tidy(F.col("lead_share")).alias("lead_share"), *[tidy(F.col(c)).alias(c) for c in ("speed_a_low", "speed_a_high", "speed_b_low", "speed_b_high")], "speeds_separated")


def _customers(spark, d):
    """Orders and account volume of the nations' customers: a stand-in for activity and volume."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    per = c.join(o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")), c.c_custkey == F.col("o_custkey"), "left")
    return per.groupBy(F.col("c_nationkey").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("paired_min"), F.round(F.coalesce(F.sum("v"), F.lit(0.0))).alias("cex_vol"), F.round(F.sum("c_acctbal")).alias("dex_vol"), F.count("*").alias("liquidity"))


def perm_spearman(spark, d):
    v = _customers(spark, d).withColumn("ratio", B.premium_ratio(F.col("cex_vol"), F.col("dex_vol")))
    r = v.select("id", N.average_rank("paired_min").alias("rx"), N.average_rank("ratio").alias("ry"))
    p = S.permutation_test(r, S.PERMUTATIONS, 0)
    return p.select(tidy(F.col("rho")).alias("rho"), tidy(F.col("p_value")).alias("p_value"), "n", "draws")


# ------------------------------------------------------------------ relations


def spearman_ratio(spark, d):
    v = _customers(spark, d).select(F.lit("all").alias("window"), F.format_string("%02d", "id").alias("symbol"), "paired_min", "cex_vol", "dex_vol", "liquidity")
    r = R.ratio_relation(v)
    ranked = v.withColumn("ratio", B.premium_ratio(F.col("cex_vol"), F.col("dex_vol"))).select(F.col("symbol").alias("id"), N.average_rank("paired_min").alias("rx"), N.average_rank("ratio").alias("ry"))
    p = S.permutation_test(ranked, S.PERMUTATIONS, 0).select(tidy(F.col("p_value")).alias("p_value"))
    return r.join(F.broadcast(p)).select("tokens", "p_value", tidy(F.col("rho")).alias("rho"), tidy(F.col("rho_trimmed")).alias("rho_trimmed"), "trimmed_tokens", tidy(F.col("rho_liquidity")).alias("rho_liquidity"), tidy(F.col("median_ratio"), 4).alias("median_ratio"), tidy(F.col("max_ratio"), 2).alias("max_ratio"))


def group_buckets(spark, d):
    universe = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_nationkey"), F.lit(1000).alias("cex_volume_24h"), F.round("c_acctbal").cast("long").alias("dex_volume_24h"))
    minutes = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.count("*").alias("paired_min"))
    g = R.build_groups(universe, minutes, F.col("c_nationkey") % 3 == 0)
    return g.select("symbol", "paired_min", tidy(F.col("ratio")).alias("ratio"), "group")


def strict_tally(spark, d):
    """Strict classes of a known weight: quantity against a part's largest."""
    top = F.max("l_quantity").over(Window.partitionBy("l_partkey"))
    w = table(spark, d, "lineitem").select((F.col("l_quantity") / top).alias("w"))
    return w.groupBy(N.strict_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))


def token_dependence(spark, d):
    s = Q.dependence(paired(spark, d), HOUR, 60)
    return s.select("leg", "token_pairs", "usable_pairs", "pairs_below_floor", "median_overlap", *[tidy(F.col(c)).alias(c) for c in ("median", "mean", "low", "high")])


def pair_spine(spark, d):
    c = R.pair_correlations(R.legs(logs(spark, d, split=True), HOUR))
    return c.select("window", "leg", "sym_a", "sym_b", "overlap", tidy(F.col("corr")).alias("corr"))


def effective_pairs(spark, d):
    s = Q.dependence(paired(spark, d), HOUR, 60)
    return R.effective_pairs(s, "token_pairs", "mean").select("leg", tidy(F.col("effective"), 4).alias("effective"))


def sign_test(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("led"))
    return s.select("user_id", "led", "total", tidy(N.sign_test(F.col("led"), F.col("total"))).alias("p"))


def windows_leadership(spark, d):
    p = paired(spark, d, split=True)
    fit = E.vecm_fit(E.log_prices(p)).select("window", "symbol", tidy(F.col("w_a"), 4).alias("w_a"))
    wide = R.leadership_across_windows(fit, R.window_labels(p))
    return wide.withColumn("spread_across_windows", tidy(F.col("spread_across_windows"), 4))


def replication(spark, d):
    fit = E.vecm_fit(logs(spark, d, split=True))
    r = R.replication(fit, "w0", "w1")
    return r.select("symbol", *[tidy(F.col(c)).alias(c) for c in ("speed_cex_first", "speed_dex_first", "speed_cex_second", "speed_dex_second")], "leads_both")


def replication_drift(spark, d):
    r = R.replication_drift(R.replication(E.vecm_fit(logs(spark, d, split=True)), "w0", "w1"))
    return r.select("shared", "led_both", tidy(F.col("largest_drift"), 4).alias("largest_drift"))


def lead_tally(spark, d):
    return R.lead_tally(E.vecm_fit(logs(spark, d, split=True)), "window")


def staleness_risk(spark, d):
    """Fill rates read off the curve that the sampling simulation gives, all of its runs."""
    c = B.coverage(bars(spark, d, split=True), 0, 1, HOUR).select("window", "symbol", "fill_rate")
    out = Q.staleness_risk(c, M.staleness(spark, [4000], M.KEEPS, M.RUNS))
    return out.select("window", "symbol", "fill_rate", tidy(F.col("false_lead_drop")).alias("false_lead_drop"), tidy(F.col("false_lead_hold")).alias("false_lead_hold"))


def floor_summary(spark, d):
    s = Q.floor_summary(Q.threshold(paired(spark, d, split=True)))
    return s.select("window", "band", "series", "leaning", tidy(F.col("median_w"), 4).alias("median_w"), "least", "most", "outside")


def alignment_summary(spark, d):
    a = Q.alignment_summary(Q.alignment(paired(spark, d, split=True), HOUR), "window")
    tidied = [c for c in a.columns if c.startswith(("median_", "largest_"))]
    return a.withColumns({c: tidy(F.col(c), 4) for c in tidied})


def pivot_lags(spark, d):
    s = Q.lag_sweep(paired(spark, d))
    return s.groupBy("symbol").pivot("lags", [1, 3, 5, 10]).agg(F.first("leads")).select("symbol", *[F.col(str(n)).alias(f"leads_{n}") for n in (1, 3, 5, 10)])


def pivot_weights(spark, d):
    """The weight at each lag order and on each grid, side by side."""
    p = paired(spark, d)
    lags = Q.widened(Q.lag_sweep(p), "symbol", "lags", [1, 3, 5, 10], "w_a", "w_lags")
    grids = Q.widened(Q.grid_sweep(p, 5 * HOUR), "symbol", "grid", ["fine", "coarse"], "w_a", "w_grid")
    both = grids.join(lags, "symbol", "left")
    return both.select("symbol", *[tidy(F.col(c), 4).alias(c) for c in both.columns if c != "symbol"])


def pivot_regimes(spark, d):
    """Premium and weight of each regime, side by side."""
    p = Q.session_panel(paired(spark, d))
    regimes = ["all", "open", "closed"]
    wide = Q.widened(p, "symbol", "regime", regimes, "mean_gap_pct", "gap").join(Q.widened(p, "symbol", "regime", regimes, "w_a", "w"), "symbol")
    return wide.select("symbol", *[tidy(F.col(c), 4).alias(c) for c in wide.columns if c != "symbol"])


def lag_flips(spark, d):
    """Distinct leaders over lag orders: more than one is a flip."""
    s = Q.lag_sweep(paired(spark, d))
    return s.groupBy("symbol").agg(F.countDistinct("leads").alias("leaders"), F.count("*").alias("orders"))


def closed_share(spark, d):
    r = B.regimes(paired(spark, d))
    return r.groupBy("symbol").agg(tidy(N.ratio(F.count_if(F.col("regime") == "closed"), F.count_if(F.col("regime") == "all"))).alias("closed_share"))


def regime_crossing(spark, d):
    s = Q.crossings(Q.sessions(paired(spark, d)))
    return s.select("symbol", tidy(F.col("w_all"), 4).alias("w_all"), tidy(F.col("w_shut"), 4).alias("w_shut"))


def crossing_summary(spark, d):
    return Q.crossing_summary(Q.sessions(paired(spark, d)))


def median_split(spark, d):
    s = R.median_split(B.spacing(paired(spark, d, split=True), HOUR), "mean_step", "window")
    return s.select("window", "symbol", tidy(F.col("mean_step")).alias("mean_step"), "half")


def pass_window(spark, d):
    s = paired(spark, d, split=True).groupBy("window").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    at = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(c) / 86400).cast("int")), "d MMMM")
    clock = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 3600) % 24, F.floor(F.col(c) / 60) % 60)
    return s.select("window", F.concat_ws(" ", at("a"), clock("a")).alias("begins"), F.concat_ws(" ", at("b"), clock("b")).alias("ends"))


def checks_table(spark, d):
    """Question, method and result of all twelve checks as text."""
    b = bars(spark, d, split=True)
    p, cover = paired(spark, d, split=True), B.coverage(b, 0, 1, HOUR)
    fits = E.vecm_fit(E.log_prices(p))
    risk = Q.staleness_risk(cover.select("window", "symbol", "fill_rate"), M.staleness(spark, [4000], M.KEEPS, M.RUNS))
    spaced = B.spacing(p, HOUR).join(fits.select("window", "symbol", "w_a"), ["window", "symbol"])
    robust = Q.robustness(p, cover).where("verdict = 'ranked'")
    across = R.leadership_across_windows(fits.select("window", "symbol", "w_a"), R.window_labels(p))
    one = paired(spark, d)
    return Q.checks_table(Q.alignment(p, HOUR), robust, E.vector_check(E.log_prices(p)), risk, spaced, Q.lag_sweep(one), Q.grid_sweep(one, 5 * HOUR), Q.dependence(one, HOUR, 60), Q.threshold(p).where("not kept"), across)


# ------------------------------------------------------------------ sets, order, joins


def topup_anti(spark, d):
    e = table(spark, d, "events")
    wanted = e.select(F.col("event_type").alias("window"), F.col("user_id").alias("symbol")).distinct()
    have = e.where("value > 50").select(F.col("event_type").alias("window"), F.col("user_id").alias("symbol"))
    return T.missing_symbols(wanted, have)


def semi_ranked(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").count().where("count >= 12")
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def key_sets(spark, d):
    """Keys of one table, the other, both; with multiplicity for differences."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    both = a.intersect(b).withColumn("part", F.lit("both"))
    return both.union(a.exceptAll(b).withColumn("part", F.lit("left"))).union(b.exceptAll(a).withColumn("part", F.lit("right"))).groupBy("part", "k").agg(F.count("*").alias("n"))


def order_contract(spark, d):
    """Keys that occur twice and rows out of the declared order."""
    t = paired(spark, d)
    repeated = T.repeated_keys(t, ["symbol", "ts"]).agg(F.count("*").alias("repeated_keys"))
    w = Window.partitionBy("symbol").orderBy("ts")
    steps = t.withColumn("g", F.col("ts") - F.lag("ts").over(w)).agg(F.count_if(F.col("g") <= 0).alias("disorder"), F.count("*").alias("rows"))
    return repeated.crossJoin(F.broadcast(steps))  # one row each


def top_gaps(spark, d):
    return B.coverage(bars(spark, d, split=True), 0, 1, HOUR).orderBy(F.desc("max_gap_min"), "symbol", "window").limit(5).select("window", "symbol", "max_gap_min")


def wide_windows(spark, d):
    t = B.coverage(bars(spark, d, split=True), 0, 1, HOUR)
    return t.groupBy("symbol").pivot("window", R.window_labels(t)).agg(F.first("paired_minutes"))


# ------------------------------------------------------------------ sources


def json_layouts(spark, d):
    """The four bar layouts, built from orders and read back; the close is a different slot in each."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), N.epoch("o_orderdate").alias("t"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))
    row = lambda *c: F.concat(F.lit('["'), F.concat_ws('","', *c), F.lit('"]'))
    t, p, z = F.col("t").cast("string"), F.col("p"), F.lit("0")
    ms = (F.col("t") * 1000).cast("string")
    frames = [
        ("a", P.exchange_a, F.concat(F.lit("["), row(t, z, p, z, z, z, z, F.lit("true")), F.lit("]"))),
        ("pool", P.pool, F.concat(F.lit('{"data":{"attributes":{"ohlcv_list":[['), F.concat_ws(",", t, z, z, z, p, z), F.lit("]]}}}"))),
        ("b", P.exchange_b, F.concat(F.lit('{"result":{"list":['), row(ms, z, z, z, p, z, z), F.lit("]}}"))),
        ("c", P.exchange_c, F.concat(F.lit("["), row(ms, z, z, z, p, z, z, z), F.lit("]"))),
    ]
    out = None
    for name, reader, payload in frames:
        f = reader(o.select("k", payload.alias("payload"))).withColumn("venue", F.lit(name))
        out = f if out is None else out.union(f)
    return out.select("k", "venue", "ts", "close")


def page_overlap(spark, d):
    """Overlapping pages: the later one wins."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), (N.epoch("ts") - N.epoch("ts") % 86400).alias("ts"), F.col("event_id").alias("page"), "value")
    return B.latest(e, ["k", "ts"], "value", "page")


def universe_screen(spark, d):
    t = table(spark, d, "part").select(F.concat(F.upper(F.substring("p_brand", 1, 8)), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "X").otherwise("Y"), F.lit("_USDT")).alias("currency_pair"), (F.col("p_retailprice") * 100).cast("string").alias("quote_volume"))
    return P.screen_universe(t, 4000.0)


def _pools(spark, d):
    s = table(spark, d, "supplier")
    symbol = F.concat(F.lit("T"), F.col("s_nationkey"), F.lit("X"))
    return s.select(symbol.alias("symbol"), F.when(F.col("s_suppkey") % 5 == 0, "other").otherwise("solana").alias("chain"), F.concat(F.lit("dex"), F.col("s_suppkey") % 3).alias("dex"), F.concat(F.lit("pool"), F.col("s_suppkey")).alias("pool"), F.lower(symbol).alias("base_symbol"), F.concat(F.when(F.col("s_suppkey") % 4 == 0, "Fake").otherwise("Xs"), F.col("s_suppkey")).alias("base_address"), F.abs("s_acctbal").alias("liquidity"), F.col("s_acctbal").alias("volume"))


def deepest_pools(spark, d):
    return P.deepest_pools(_pools(spark, d), "Xs")


def impostors(spark, d):
    return P.impostors(_pools(spark, d), "Xs")


def registry_check(spark, d):
    mine = P.deepest_pools(_pools(spark, d), "Xs").select("symbol", "mint")
    s = table(spark, d, "supplier")
    issuer = s.where("s_suppkey % 3 <> 0").groupBy(F.concat(F.lit("T"), F.col("s_nationkey"), F.lit("X")).alias("symbol")).agg(F.concat(F.lit("Xs"), F.min("s_suppkey")).alias("address"))
    registry = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("Xs"), F.col("s_suppkey")).alias("address"), F.col("s_name").alias("name"))
    return P.verify_mints(mine, issuer, registry)


def issuer_list(spark, d):
    """Nested pages of an issuer's tokens: deployments exploded, one network kept, the last page wins."""
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("page_no"), "s_suppkey", "s_nationkey")
    dep = F.array(F.struct(F.when(F.col("s_suppkey") % 3 == 0, "ether").otherwise("solana").alias("network"), F.concat(F.lit("Xs"), F.col("s_suppkey")).alias("address")))
    node = F.struct("s_suppkey", F.concat(F.lit("t"), F.col("s_nationkey"), F.lit("x")).alias("symbol"), dep.alias("deployments"))
    pages = s.select("page_no", node.alias("n")).groupBy("page_no").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: F.struct(n["symbol"].alias("symbol"), n["deployments"].alias("deployments"))).alias("nodes"))
    return P.issuer_list(pages.select("page_no", F.to_json(F.struct("nodes")).alias("payload")))


def pool_search(spark, d):
    """Pool search payloads written as JSON and read back; missing liquidity counts as 0."""
    p = _pools(spark, d)
    usd = F.when(F.col("liquidity") > 1000, F.col("liquidity"))
    one = F.struct(F.col("chain").alias("chainId"), F.col("dex").alias("dexId"), F.col("pool").alias("pairAddress"), F.struct(F.col("base_symbol").alias("symbol"), F.col("base_address").alias("address")).alias("baseToken"), F.struct(usd.alias("usd")).alias("liquidity"), F.struct(F.col("volume").alias("h24")).alias("volume"))
    back = P.search_pairs(p.select("symbol", F.to_json(F.struct(F.array(one).alias("pairs"))).alias("payload")))
    return back.select("symbol", "chain", "dex", "pool", "base_address", "liquidity", "volume")


def universe_build(spark, d):
    """Tickers joined to their deepest genuine pool: one row for each paired token, by volume."""
    best = P.deepest_pools(_pools(spark, d), "Xs")
    t = table(spark, d, "nation").join(table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.abs("c_acctbal")).alias("v")), F.col("n_nationkey") == F.col("c_nationkey"))
    tickers = t.select(F.concat(F.lit("T"), F.col("n_nationkey"), F.lit("X_USDT")).alias("currency_pair"), F.round("v").cast("string").alias("quote_volume"))
    return P.screen_universe(tickers).join(best, "symbol").select("symbol", F.col("currency_pair").alias("cex_pair"), "cex_volume_24h", "mint", "pool", "dex", "dex_liquidity", "dex_volume_24h")


def group_medians(spark, d):
    """Count, median and sample deviation by group."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.percentile("l_quantity", 0.5).alias("median_quantity"), tidy(F.stddev_samp("l_discount")).alias("sd_discount"), tidy(F.covar_samp("l_quantity", "l_discount")).alias("cov"))


def rolling_sums(spark, d):
    """Sums over blocks of ten rows, by difference of running sums and so in one pass."""
    w = B.ordered()
    p = paired(spark, d).withColumns({"p": F.sum("cex").over(w.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(w)})
    return p.withColumn("s", F.col("p") - F.coalesce(F.lag("p", 10).over(w), F.lit(0.0))).where("i >= 10").select("symbol", "ts", tidy(F.col("s"), 4).alias("block_sum"))


def sets_disjoint(spark, d):
    """Groups whose keys share nothing with another table's keys."""
    known = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k")).distinct().withColumn("hit", F.lit(1))
    c = table(spark, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 40 + F.when(F.col("c_mktsegment") == "BUILDING", 100).otherwise(0)).alias("k"))
    return c.join(known, "k", "left").groupBy("c_mktsegment").agg((F.count("hit") == 0).alias("disjoint"))


def mirror_drift(spark, d):
    """Datasets whose content differs between two mirrors, or that one of them lacks."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), F.sha2("n_name", 256).alias("sha"))
    other = n.where("k % 5 <> 0").select("name", F.when(F.col("k") % 7 == 0, F.sha2(F.lower("name"), 256)).otherwise(F.col("sha")).alias("sha"))
    return T.drifted_files(n.select("name", "sha"), other)


def simulated_pair(spark, d):
    """The simulator as a SQL table function."""
    M.register(spark)
    return spark.sql("SELECT * FROM simulate_pair(500, 0.0D, 0.4D, 0.0005D, 0.0D, 0)")


# ------------------------------------------------------------------ text


def text_flatten(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.flat(F.col("text"))).alias("flat_md5"))


def phrase_presence(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.present(t, "2.0").alias("has_2_0"), X.present(t, "the").alias("has_the"))


def number_tokens(spark, d):
    n = X.numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(n).alias("n"), F.array_join(F.array_sort(n), ",").alias("numbers"), F.array_join(F.array_sort(X.numbers(F.col("text"), signed=True)), ",").alias("signed"))


def _markdown(spark, d):
    """Documents with a small table in front of their text, from their own fields."""
    doc = table(spark, d, "documents")
    head = F.concat(F.lit("| id | lang |\n| --- | --- |\n| "), F.col("doc_id"), F.lit(" | "), F.col("lang"), F.lit(" |\n| "), F.col("n_chars"), F.lit(" | "), F.col("source"), F.lit(" |\n\n"))
    return doc.select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def markdown_table(spark, d):
    rows = X.markdown_rows(F.col("text"), ["id", "lang"])
    r = _markdown(spark, d).select("doc_id", F.posexplode(F.filter(rows, lambda r: ~F.element_at(r, 1).startswith("-"))).alias("row", "cells"))
    return r.select("doc_id", "row", F.col("cells")[0].alias("id"), F.col("cells")[1].alias("lang"))


def html_cells(spark, d):
    """Rows of tables rendered from events and taken apart again."""
    e = table(spark, d, "events")
    page = F.concat(F.lit("<p>x</p><table><tr><th>type</th><th>value</th></tr>"), X.html_row([F.col("event_type"), F.col("value")], F.when(F.col("value") > 100, F.lit("good"))), F.lit("</table><table><tr><th>no</th></tr><tr><td>1</td></tr></table>"))
    r = e.select("event_id", F.explode(X.html_rows(page, ["type", "value"])).alias("c"))
    return r.select("event_id", F.col("c")[0].alias("event_type"), F.col("c")[1].cast("double").alias("value"))


def page_links(spark, d):
    """Tags of raw pages: the same extraction over html as it comes."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))).alias("paragraphs"), F.size(X.html_rows(h, ["a"])).alias("cells"))


def html_report(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.select(F.col("n_nationkey").alias("k"), X.html_row([F.col("n_nationkey"), F.col("n_name")], F.when(F.col("n_regionkey") == 0, F.lit("tone"))).alias("html"))
    more = r.select(F.col("r_regionkey").alias("k"), X.html_row([F.col("r_name")]).alias("html"))
    return C.html_page("Report", [("Nations", C.html_table(rows, ["key", "name"], "k")), ("Regions", C.html_table(more, ["name"], "k"))])


def spelled_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", X.spelled(F.col("p_size")).alias("spelled"))


def prose_blocks(spark, d):
    b = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "block"))
    return b.groupBy("doc_id").agg(F.count_if(X.is_prose(F.col("block"))).alias("prose"), F.count("*").alias("blocks"))


def compound_rejoin(spark, d):
    broken = F.regexp_replace("text", r"(\w)(\w\w) ", "$1-\n$2 ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.rejoin_compounds(broken)).alias("joined_md5"))


def link_heal(spark, d):
    """Whole texts with a broken link in front of each."""
    text = F.concat(F.lit("see [x](http://a.b/"), F.col("doc_id"), F.lit("\n/(c "), F.col("lang"), F.lit(") and ("), F.col("source"), F.lit(" d) "), F.coalesce("text", F.lit("")))
    healed = X.heal_links(text)
    return table(spark, d, "documents").select("doc_id", F.substring(healed, 1, 40).alias("head"), F.md5(healed).alias("healed_md5"))


def wrap(spark, d):
    return table(spark, d, "documents").select("doc_id", X.wrapped(F.col("text")).alias("wrapped"))


def spoken_dates(spark, d):
    label = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", X.spoken_date(label).alias("spoken"))


def ascii_scan(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.is_ascii(t).alias("ascii"), F.size(X.found_in(t, X.DASHES)).alias("dashes"), F.array_join(X.found_in(t, X.AMERICAN), ",").alias("american"), F.array_join(X.found_in(t, X.FILLER), ",").alias("filler"))


def fenced_commands(spark, d):
    text = F.concat(F.lit("run tool "), F.col("role"), F.lit("\n```\ntool hidden"), F.col("turn"), F.lit("\n```\nthen tool t"), F.col("conv_id") % 7, F.lit(" "), F.coalesce("text", F.lit("")))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.commands(X.without_fences(text), "tool")).alias("argument"))
    known = table(spark, d, "conversations").select(F.col("role").alias("argument")).distinct()
    return c.join(known, "argument", "left_anti").select("conv_id", "turn", "argument")


# ------------------------------------------------------------------ claims


def _claims(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    metrics = e.select(F.col("event_type").alias("metric"), F.col("n").cast("double").alias("value"))
    texts = e.select(F.substring("event_type", 1, 1).alias("surface"), F.concat(F.lit("There  were\n"), F.col("n"), F.lit(" of "), F.col("event_type"))).toDF("surface", "text")
    off = F.when(F.col("event_type") == "view", 1.0).otherwise(0.005)
    claims = e.select(F.substring("event_type", 1, 1).alias("surface"), F.concat(F.lit("count of "), F.col("event_type")).alias("label"), F.col("event_type").alias("metric"), (F.col("n") + off).alias("want"), F.concat(F.lit("were "), F.when(F.col("event_type") == "click", F.floor(F.col("n") / 10)).otherwise(F.col("n"))).alias("phrase"))
    return claims, metrics, texts


def claims_check(spark, d):
    return C.check_values(*_claims(spark, d))


def claims_tally(spark, d):
    return C.tally(C.check_values(*_claims(spark, d)), F.col("drifted") | F.col("missing"))


def direction_check(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    texts = e.select(F.col("event_type").alias("surface"), F.concat(F.lit("mean is "), F.when(F.col("m") > 50, "above").otherwise("below"), F.lit(" fifty")).alias("text"))
    claims = e.select(F.col("event_type").alias("surface"), F.lit("above").alias("label"), (F.col("m") > F.when(F.col("event_type") == "error", 1000.0).otherwise(50.0)).alias("holds"), F.lit("is above fifty").alias("phrase"))
    return C.check_directions(claims, texts)


def table_compare(spark, d):
    n = table(spark, d, "nation")
    cells = lambda c: n.select(F.col("n_nationkey").cast("string").alias("row"), F.lit("name").alias("col"), c.alias("value"))
    return C.compare_cells(cells(F.col("n_name")), cells(F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name"))))


# ------------------------------------------------------------------ simulation, streaming


def sim_calibration(spark, d):
    return M.calibration(spark, M.SPEEDS, M.SEEDS)


def calibration_summary(spark, d):
    return M.calibration_summary(M.calibration(spark, M.SPEEDS, M.SEEDS))


def sim_staleness(spark, d):
    return M.false_lead_curve(M.staleness(spark, [4000], M.KEEPS, M.RUNS))


def sim_staleness_matched(spark, d):
    """Every run at the lengths of real pairs; one too short to fit stays, without a weight."""
    r = M.staleness(spark, *M.MATCHED, M.RUNS, schemes=("drop",), shift=7000)
    return r.select("n", "keep", "seed", "rows", tidy(F.col("weight_a")).alias("w_cex"), F.col("speed_a").isNotNull().alias("fitted"))


def stream_pairs(spark, d):
    """A streaming run to its end over the events; the last buckets stay open behind the watermark."""
    import tempfile

    from ..streaming.bars import paired_stream

    schema = table(spark, d, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = src.select(F.lit("all").alias("window"), F.col("event_type").alias("symbol"), (F.col("user_id") % 2).alias("venue"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "value")
    out = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()) + f"/pairs-{uuid.uuid4().hex}"
    q = paired_stream(t, "1 hour", "1 hour").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("window string, symbol string, ts long, cex double, dex double").parquet(f"{out}/rows")


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    bars_close, paired_bars, coverage, spacing, moves_premium, session_regimes, gap_changes, realign, dense_lag_profile, grid_resample, forward_fill, thin_drop, thin_hold, orders_paired,
    vecm_fit, vecm_lag_sweep, vecm_grid, vecm_sessions, vecm_threshold, vecm_orders, hasbrouck, adf_spread, vector_check, alignment, session_panel, venue_matrix, robustness,
    bootstrap_lead, perm_spearman, spearman_ratio, group_buckets, strict_tally, token_dependence, pair_spine, effective_pairs, sign_test, windows_leadership, replication, replication_drift, lead_tally, staleness_risk,
    floor_summary, alignment_summary, pivot_lags, pivot_weights, pivot_regimes, lag_flips, closed_share, regime_crossing, crossing_summary, median_split, pass_window, checks_table,
    topup_anti, semi_ranked, key_sets, order_contract, top_gaps, wide_windows, json_layouts, page_overlap, universe_screen, deepest_pools, impostors, registry_check,
    issuer_list, pool_search, universe_build, group_medians, rolling_sums, sets_disjoint, mirror_drift, simulated_pair,
    text_flatten, phrase_presence, number_tokens, markdown_table, html_cells, page_links, html_report, spelled_numbers, prose_blocks, compound_rejoin, link_heal, wrap, spoken_dates, ascii_scan, fenced_commands,
    claims_check, claims_tally, direction_check, table_compare, sim_calibration, calibration_summary, sim_staleness, sim_staleness_matched, stream_pairs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
