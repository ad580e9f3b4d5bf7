"""DuckDB statements for the queries.  Regressions go by Gram-Schmidt over windows, a way of their own."""

from __future__ import annotations

HOUR = 3600
WINDOW = "'w' || ((sec - 1704067200) // 864000)"


def _r(x: str, digits: int = 6) -> str:
    return f"round(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {digits}) + 0.0"


def _paired(width: int = HOUR, split: bool = False, venues: int = 2) -> str:
    """CTEs bars(window_, symbol, venue, ts, close) and paired(window_, symbol, ts, cex, dex)."""
    window = WINDOW if split else "'all'"
    return f"""
t0 AS (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events WHERE value > 0),
t1 AS (SELECT {window} AS window_, event_type AS symbol, user_id % {venues} AS venue, (sec // {width}) * {width} AS b, value, ts, event_id FROM t0),
t2 AS (SELECT *, row_number() OVER (PARTITION BY window_, symbol, venue, b ORDER BY ts DESC, event_id DESC) AS k FROM t1),
bars AS (SELECT window_, symbol, venue, b AS ts, value AS close FROM t2 WHERE k = 1),
paired AS (SELECT window_, symbol, ts, max(CASE WHEN venue = 0 THEN close END) AS cex, max(CASE WHEN venue = 1 THEN close END) AS dex FROM bars GROUP BY ALL HAVING cex IS NOT NULL AND dex IS NOT NULL)"""


ORDERS = """
o0 AS (SELECT o_orderpriority AS symbol, o_custkey % 2 AS venue, (epoch_us(o_orderdate) // 1000000) // 86400 * 86400 AS b, o_totalprice AS value, o_orderkey, epoch_us(o_orderdate) // 1000000 AS sec FROM orders WHERE o_totalprice > 0),
o1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, venue, b ORDER BY sec DESC, o_orderkey DESC) AS k FROM o0),
paired AS (SELECT 'all' AS window_, symbol, b AS ts, max(CASE WHEN venue = 0 THEN value END) AS cex, max(CASE WHEN venue = 1 THEN value END) AS dex FROM o1 WHERE k = 1 GROUP BY ALL HAVING cex IS NOT NULL AND dex IS NOT NULL)"""


def _design(src: str = "paired", out: str = "d", lags: int = 5, keys: str = "window_, symbol", beta: str = "1.0") -> str:
    """CTE with s, da*, db*, ya, yb, n of src(keys, ts, cex, dex); beta may be a column of src."""
    more = "" if beta == "1.0" else f", {beta}"
    cols = []
    for i in range(1, lags + 1):
        cols += [f"lag(a, {i}) OVER w - lag(a, {i + 1}) OVER w AS da{i}", f"lag(b, {i}) OVER w - lag(b, {i + 1}) OVER w AS db{i}"]
    return f"""
{out}_l AS (SELECT {keys}, ts, ln(cex) AS a, ln(dex) AS b{more} FROM {src}),
{out}_x AS (SELECT {keys}, ts, count(*) OVER (PARTITION BY {keys}) AS n, lag(a) OVER w - {beta} * lag(b) OVER w AS s, a - lag(a) OVER w AS ya, b - lag(b) OVER w AS yb, {", ".join(cols)}, lag(a, {lags + 1}) OVER w AS full_ FROM {out}_l WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
{out} AS (SELECT * EXCLUDE (full_), 1.0::DOUBLE AS one FROM {out}_x WHERE full_ IS NOT NULL AND n >= {4 * lags + 20})"""


def _mgs(src: str, out: str, regressors: list[str], targets: list[str], keys: str) -> str:
    """Residuals of the last regressor and the targets after all other regressors: CTE ``out``_z."""
    ctes, now = [], src
    names = regressors + targets
    for k, q in enumerate(regressors[:-1]):
        rest = names[k + 1 :]
        nxt = f"{out}_{k}" if k < len(regressors) - 2 else f"{out}_z"
        picks = ", ".join(f"{c} - {q} * (sum({c} * {q}) OVER w / nullif(sum({q} * {q}) OVER w, 0)) AS {c}" for c in rest)
        ctes.append(f"{nxt} AS (SELECT {keys}, {'n, ' if k >= 0 else ''}{picks} FROM {now} WINDOW w AS (PARTITION BY {keys}))")
        now = nxt
    return ",\n".join(ctes)


def _fit(src: str = "d", out: str = "f", lags: int = 5, keys: str = "window_, symbol") -> str:
    """CTE ``out``(keys, minutes, speed_a, speed_b, leads, w_a, oaa, oab, obb, rows_)."""
    regs = ["one", *[f"{v}{i}" for i in range(1, lags + 1) for v in ("da", "db")], "s"]
    part = f"PARTITION BY {keys}"
    return f"""
{_mgs(src, out, regs, ["ya", "yb"], keys)},
{out}_r AS (SELECT {keys}, n, sum(s * ya) OVER w / sum(s * s) OVER w AS sa, sum(s * yb) OVER w / sum(s * s) OVER w AS sb, s, ya, yb FROM {out}_z WINDOW w AS ({part})),
{out} AS (SELECT {keys}, max(n) AS minutes, max(sa) AS speed_a, max(sb) AS speed_b, abs(max(sa)) < abs(max(sb)) AS leads, CASE WHEN abs(max(sa) - max(sb)) >= 1e-12 THEN -max(sb) / (max(sa) - max(sb)) END AS w_a,
  sum((ya - sa * s) * (ya - sa * s)) / (count(*) - 1) AS oaa, sum((ya - sa * s) * (yb - sb * s)) / (count(*) - 1) AS oab, sum((yb - sb * s) * (yb - sb * s)) / (count(*) - 1) AS obb FROM {out}_r GROUP BY {keys})"""


def _vecm(src: str = "paired", tag: str = "f", lags: int = 5, keys: str = "window_, symbol", beta: str = "1.0") -> str:
    return _design(src, f"{tag}d", lags, keys, beta) + "," + _fit(f"{tag}d", tag, lags, keys)


def _adf(src: str, tag: str, keys: str = "window_, symbol", lags: int = 5) -> str:
    """CTE ``tag``(keys, n, adf, half_life, stationary) of src(keys, ts, z)."""
    cols = ", ".join(f"lag(z, {i}) OVER w - lag(z, {i + 1}) OVER w AS d{i}" for i in range(1, lags + 1))
    regs = [*[f"d{i}" for i in range(1, lags + 1)], "z1"]
    return f"""
{tag}_x AS (SELECT {keys}, count(*) OVER (PARTITION BY {keys}) AS n, lag(z) OVER w AS z1, z - lag(z) OVER w AS dz, {cols}, lag(z, {lags + 1}) OVER w AS full_ FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
{tag}_d AS (SELECT * EXCLUDE (full_) FROM {tag}_x WHERE full_ IS NOT NULL AND n >= {lags + 20}),
{_mgs(f"{tag}_d", tag, regs, ["dz"], keys)},
{tag}_r AS (SELECT {keys}, n, z1, dz, sum(z1 * dz) OVER w / sum(z1 * z1) OVER w AS g FROM {tag}_z WINDOW w AS (PARTITION BY {keys})),
{tag}_s AS (SELECT {keys}, max(n) AS n, max(g) AS g, max(g) / sqrt(sum((dz - g * z1) * (dz - g * z1)) / (count(*) - {lags + 1}) / sum(z1 * z1)) AS adf FROM {tag}_r GROUP BY {keys}),
{tag} AS (SELECT {keys}, n, adf, CASE WHEN 1 + g > 0 AND 1 + g < 1 THEN ln(0.5) / ln(1 + g) END AS half_life, adf < -1.941 AS stationary FROM {tag}_s)"""


def _spread(src: str, out: str, beta: str = "1.0", keys: str = "window_, symbol") -> str:
    return f"{out} AS (SELECT {keys}, ts, ln(cex) - {beta} * ln(dex) - avg(ln(cex) - {beta} * ln(dex)) OVER (PARTITION BY {keys}) AS z FROM {src})"


def _coverage(split: bool = False) -> str:
    return (
        _paired(split=split)
        + f""",
c0 AS (SELECT *, greatest(min(CASE WHEN venue = 0 THEN ts END) OVER w, min(CASE WHEN venue = 1 THEN ts END) OVER w) AS lo, least(max(CASE WHEN venue = 0 THEN ts END) OVER w, max(CASE WHEN venue = 1 THEN ts END) OVER w) AS hi,
  count(CASE WHEN venue = 0 THEN 1 END) OVER w * count(CASE WHEN venue = 1 THEN 1 END) OVER w AS both_ FROM bars WINDOW w AS (PARTITION BY window_, symbol)),
c1 AS (SELECT window_, symbol, count(CASE WHEN venue = 0 THEN 1 END) AS cex_minutes, count(CASE WHEN venue = 1 THEN 1 END) AS dex_minutes, (max(ts) - min(ts)) // {HOUR} + 1 AS window_minutes FROM c0 WHERE both_ > 0 AND ts BETWEEN lo AND hi GROUP BY ALL),
c2 AS (SELECT window_, symbol, ts, (ts - lag(ts) OVER (PARTITION BY window_, symbol ORDER BY ts)) // {HOUR} AS gap FROM paired),
c3 AS (SELECT window_, symbol, count(*) AS paired_minutes, coalesce(floor(quantile_cont(gap, 0.5)), 0)::BIGINT AS median_gap_min, coalesce(max(gap), 0) AS max_gap_min, round(coalesce(avg(CASE WHEN gap = 1 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0), 4) AS consecutive_share, min(ts) AS first_ts, max(ts) AS last_ts FROM c2 GROUP BY ALL),
cover AS (SELECT *, round(paired_minutes / window_minutes, 4) AS fill_rate FROM c1 JOIN c3 USING (window_, symbol))"""
    )


OPEN = "((ts // 86400 + 3) % 7 < 5 AND (ts // 60) % 1440 >= 810 AND (ts // 60) % 1440 < 1200)"
REALIGN = f"m0 AS (SELECT *, lead(ts) OVER w AS t1, lead(cex) OVER w AS c1 FROM paired WINDOW w AS (PARTITION BY window_, symbol ORDER BY ts)), moved AS (SELECT window_, symbol, ts, c1 AS cex, dex FROM m0 WHERE t1 - ts = {HOUR})"


def _dense(src: str = "paired") -> str:
    return f"""g0 AS (SELECT window_, symbol, unnest(generate_series(min(ts), max(ts), {HOUR})) AS ts FROM {src} GROUP BY window_, symbol),
grid AS (SELECT window_, symbol, ts, cex, dex FROM g0 LEFT JOIN {src} USING (window_, symbol, ts))"""


def _cov(x: str, y: str) -> str:
    ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    a, b = f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _profile() -> str:
    shifts = ", ".join(f"{'lag' if k >= 0 else 'lead'}(db, {abs(k)}) OVER w AS b{i}" for i, k in enumerate(range(-3, 4)))
    longs = " UNION ALL ".join(f"SELECT window_, symbol, {k} AS lag, {_cov('da', f'b{i}')} AS corr FROM p2 GROUP BY ALL" for i, k in enumerate(range(-3, 4)))
    return f"""{_dense()},
p0 AS (SELECT *, ln(cex) AS a, ln(dex) AS b FROM grid),
p1 AS (SELECT window_, symbol, ts, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM p0 WINDOW w AS (PARTITION BY window_, symbol ORDER BY ts)),
p2 AS (SELECT *, {shifts} FROM p1 WINDOW w AS (PARTITION BY window_, symbol ORDER BY ts)),
p3 AS ({longs}),
p4 AS (SELECT *, row_number() OVER (PARTITION BY window_, symbol ORDER BY corr DESC NULLS LAST, lag DESC) AS k FROM p3),
profile AS (SELECT window_, symbol, max(CASE WHEN k = 1 AND corr IS NOT NULL THEN lag END) AS best_lag, max(CASE WHEN lag = 0 THEN corr END) AS corr_at_zero, max(CASE WHEN k = 1 THEN corr END) AS corr_at_best FROM p4 GROUP BY ALL)"""


def _uniform(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


SPEEDS = f"{_r('speed_a')} AS speed_a, {_r('speed_b')} AS speed_b"
AVG_RANK = "rank() OVER ({p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}{x}) - 1) / 2.0"


def _rank(x: str, group: str = "") -> str:
    return AVG_RANK.format(p=f"PARTITION BY {group}" if group else "", x=x, g=f"{group}, " if group else "")


CUSTOMERS = """
v0 AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
v AS (SELECT c_nationkey AS id, coalesce(sum(n), 0)::BIGINT AS paired_min, round(coalesce(sum(v), 0)) AS cex_vol, round(sum(c_acctbal)) AS dex_vol, count(*) AS liquidity FROM customer LEFT JOIN v0 ON c_custkey = o_custkey GROUP BY ALL),
vr AS (SELECT *, cex_vol / greatest(dex_vol, 1) AS ratio FROM v)"""


def _bootstrap(draws: int = 400) -> str:
    keys = "window_, symbol, draw"
    names = ["one", *[f"{v}{i}" for i in range(1, 6) for v in ("da", "db")], "s", "ya", "yb"]
    return f"""{_paired()},{_design()},
e0 AS (SELECT *, row_number() OVER (PARTITION BY window_, symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY window_, symbol) AS m FROM d),
e1 AS (SELECT DISTINCT window_, symbol, m, greatest(10, round(pow(m, 1.0 / 3.0))::BIGINT) AS size FROM e0),
e2 AS (SELECT *, unnest(generate_series(0, {draws - 1})) AS draw FROM e1 WHERE m >= 4 * size),
e3 AS (SELECT *, unnest(generate_series(0, ceil(m / size)::BIGINT - 1)) AS block FROM e2),
e4 AS (SELECT *, {_uniform("concat_ws('|', 0, symbol, draw, block)")} % (m - size + 1) AS start, least(size, m - block * size) AS width FROM e3),
e5 AS (SELECT e4.window_, e4.symbol, e4.draw, e0.n, {", ".join(f"e0.{c}" for c in names)} FROM e4 JOIN e0 ON e0.window_ = e4.window_ AND e0.symbol = e4.symbol AND e0.idx >= start AND e0.idx < start + width),
{_fit("e5", "bf", 5, keys)},
boot AS (SELECT window_, symbol, count(*) AS draws, avg(leads::INT) AS lead_share, quantile_cont(speed_a, 0.05) AS speed_a_low, quantile_cont(speed_a, 0.95) AS speed_a_high, quantile_cont(speed_b, 0.05) AS speed_b_low, quantile_cont(speed_b, 0.95) AS speed_b_high FROM bf WHERE w_a IS NOT NULL GROUP BY ALL)"""


def _shares() -> str:
    return """h0 AS (SELECT *, w_a * w_a * oaa + 2 * w_a * (1 - w_a) * oab + (1 - w_a) * (1 - w_a) * obb AS total, least(1.0, oab * oab / (oaa * obb)) AS rho2 FROM f),
h1 AS (SELECT *, pow(w_a * sqrt(oaa) + (1 - w_a) * oab / sqrt(oaa), 2) / total AS first_, w_a * w_a * oaa * (1 - rho2) / total AS last_ FROM h0),
shares AS (SELECT *, least(first_, last_) AS is_low, greatest(first_, last_) AS is_high, greatest(-0.999999, least(0.999999, oab / sqrt(oaa * obb))) AS rho FROM h1)"""


def _legs(split: bool = False) -> str:
    return f"""{_paired(split=split)},
l0 AS (SELECT window_, symbol, ts, unnest(['cex', 'dex', 'spread']) AS leg, unnest([ln(cex), ln(dex), ln(cex) - ln(dex)]) AS x FROM paired),
l1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w = {HOUR} THEN x - lag(x) OVER w END AS change FROM l0 WINDOW w AS (PARTITION BY window_, leg, symbol ORDER BY ts)),
l2 AS (SELECT window_, leg, symbol, ts, change FROM l1 WHERE change IS NOT NULL),
names AS (SELECT DISTINCT window_, leg, symbol FROM l2),
spine AS (SELECT a.window_, a.leg, a.symbol AS sym_a, b.symbol AS sym_b FROM names a JOIN names b ON a.window_ = b.window_ AND a.leg = b.leg AND a.symbol < b.symbol),
met AS (SELECT a.window_, a.leg, a.symbol AS sym_a, b.symbol AS sym_b, count(*) AS overlap, {_cov("a.change", "b.change")} AS corr FROM l2 a JOIN l2 b ON a.window_ = b.window_ AND a.leg = b.leg AND a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL),
pairs AS (SELECT window_, leg, sym_a, sym_b, coalesce(overlap, 0) AS overlap, corr FROM spine LEFT JOIN met USING (window_, leg, sym_a, sym_b)),
dep AS (SELECT leg, count(*) AS token_pairs, count(CASE WHEN overlap >= 60 THEN corr END) AS usable_pairs, count(CASE WHEN overlap < 60 THEN 1 END) AS pairs_below_floor, floor(quantile_cont(overlap, 0.5))::BIGINT AS median_overlap,
  quantile_cont(CASE WHEN overlap >= 60 THEN corr END, 0.5) AS median, avg(CASE WHEN overlap >= 60 THEN corr END) AS mean, min(CASE WHEN overlap >= 60 THEN corr END) AS low, max(CASE WHEN overlap >= 60 THEN corr END) AS high FROM pairs GROUP BY ALL)"""


LAG_FITS = ",".join(_vecm("paired", f"f{n}", n) for n in (1, 3, 5, 10))
LAG_UNION = " UNION ALL ".join(f"SELECT {n} AS lags, * FROM f{n}" for n in (1, 3, 5, 10))
SESSIONS = f"""{_paired()},{_vecm("paired", "f")},
shut AS (SELECT * FROM paired WHERE NOT {OPEN}),
shut2 AS (SELECT * FROM shut QUALIFY count(*) OVER (PARTITION BY window_, symbol) >= 120),{_vecm("shut2", "g")},
sess AS (SELECT p.symbol, count(*) AS minutes_all, count(CASE WHEN NOT {OPEN} THEN 1 END) AS minutes_shut FROM paired p GROUP BY ALL),
sess2 AS (SELECT s.*, f.leads AS leads_all, g.leads AS leads_shut, f.w_a AS w_all, g.w_a AS w_shut FROM sess s LEFT JOIN f USING (symbol) LEFT JOIN g USING (symbol))"""
THRESHOLD = f"""{_paired(split=True)},{_vecm()},
thr AS (SELECT window_, symbol, count(*) AS minutes, count(*) >= 120 AS kept FROM paired GROUP BY ALL),
thr2 AS (SELECT t.*, f.speed_a, f.speed_b, f.leads, f.w_a FROM thr t LEFT JOIN f USING (window_, symbol))"""


def _alignment(split: bool = False) -> str:
    return f"""{_paired(split=split)},{REALIGN},{_vecm("paired", "f")},{_vecm("moved", "g")},
{_spread("paired", "z0")},{_adf("z0", "az")},{_spread("moved", "z1")},{_adf("z1", "bz")},{_profile()},
n0 AS (SELECT window_, symbol, count(*) AS rows_as_collected, CASE WHEN count(*) >= 20 THEN stddev_samp(ln(cex) - ln(dex)) * 1e4 END AS sd0 FROM paired GROUP BY ALL),
n1 AS (SELECT window_, symbol, count(*) AS rows_realigned, CASE WHEN count(*) >= 20 THEN stddev_samp(ln(cex) - ln(dex)) * 1e4 END AS sd1 FROM moved GROUP BY ALL),
al AS (SELECT n0.window_, n0.symbol, rows_as_collected, coalesce(rows_realigned, 0) AS rows_realigned, sd0, sd1, f.leads AS leads_as_collected, g.leads AS leads_realigned, f.w_a AS w0, g.w_a AS w1, az.stationary AS stationary_as_collected, bz.stationary AS stationary_realigned, best_lag, corr_at_zero, corr_at_best
  FROM n0 LEFT JOIN n1 USING (window_, symbol) LEFT JOIN f USING (window_, symbol) LEFT JOIN g USING (window_, symbol) LEFT JOIN az USING (window_, symbol) LEFT JOIN bz USING (window_, symbol) LEFT JOIN profile USING (window_, symbol))"""


#: FIXED VALUES: false-lead rates of the published simulation, by share kept (dropped, held).
CURVE = "(VALUES (0.05, 0.375, 1.0), (0.1, 0.2, 1.0), (0.2, 0.175, 1.0), (0.3, 0.125, 1.0), (0.45, 0.025, 1.0), (0.6, 0.0, 1.0), (0.8, 0.0, 0.95), (1.0, 0.0, 0.0))"
SPELLED = "{1: 'one', 2: 'two', 3: 'three', 4: 'four', 5: 'five', 6: 'six', 7: 'seven', 8: 'eight', 9: 'nine', 10: 'ten', 11: 'eleven', 12: 'twelve', 13: 'thirteen', 14: 'fourteen', 15: 'fifteen', 16: 'sixteen', 17: 'seventeen', 18: 'eighteen', 19: 'nineteen', 20: 'twenty', 21: 'twenty-one', 22: 'twenty-two', 23: 'twenty-three', 24: 'twenty-four', 26: 'twenty-six', 35: 'thirty-five', 60: 'sixty', 96: 'ninety-six'}"
POOLS = """pools AS (SELECT 'T' || s_nationkey || 'X' AS symbol, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'solana' END AS chain, 'dex' || (s_suppkey % 3) AS dex, 'pool' || s_suppkey AS pool,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Fake' ELSE 'Xs' END || s_suppkey AS base_address, abs(s_acctbal) AS liquidity, s_acctbal AS volume FROM supplier),
best AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY liquidity DESC, pool) AS k FROM pools WHERE chain = 'solana' AND starts_with(base_address, 'Xs'))"""
CLAIMS = """e AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY ALL),
res AS (SELECT substr(c.t, 1, 1) AS surface, 'count of ' || c.t AS label, c.n::DOUBLE AS got, c.n + CASE WHEN c.t = 'view' THEN 1.0::DOUBLE ELSE 0.005::DOUBLE END AS want, abs(c.n - (c.n + CASE WHEN c.t = 'view' THEN 1.0 ELSE 0.005 END)) > 0.011 AS drifted, c.t = 'click' AS missing FROM e c)"""
PANEL = f"""{_paired()},
r0 AS (SELECT window_, symbol, unnest(['all', CASE WHEN {OPEN} THEN 'open' ELSE 'closed' END]) AS regime, ts, cex, dex FROM paired),
r1 AS (SELECT *, coalesce((cex <> lag(cex) OVER w)::INT, 1) AS ma, coalesce((dex <> lag(dex) OVER w)::INT, 1) AS mb FROM r0 WINDOW w AS (PARTITION BY window_, symbol, regime ORDER BY ts)),
r2 AS (SELECT window_, symbol, regime, count(*) AS minutes, sum(ma)::BIGINT AS cex_moves, sum(mb)::BIGINT AS dex_moves, avg((cex / dex - 1) * 100) AS mean_gap_pct FROM r1 GROUP BY ALL HAVING minutes >= 30),{_vecm("r0", "f", 5, "window_, symbol, regime")}"""
MATRIX = f"""
t0 AS (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events WHERE value > 0),
t2 AS (SELECT user_id % 4 AS venue, sec // {HOUR} * {HOUR} AS b, value, row_number() OVER (PARTITION BY user_id % 4, sec // {HOUR} ORDER BY ts DESC, event_id DESC) AS k FROM t0),
bars AS (SELECT venue, b AS ts, value AS close FROM t2 WHERE k = 1),
paired AS (SELECT x.venue::VARCHAR AS venue_a, y.venue::VARCHAR AS venue_b, ts, x.close AS cex, y.close AS dex FROM bars x JOIN bars y USING (ts) WHERE x.venue < y.venue),
r1 AS (SELECT *, coalesce((cex <> lag(cex) OVER w)::INT, 1) AS ma, coalesce((dex <> lag(dex) OVER w)::INT, 1) AS mb FROM paired WINDOW w AS (PARTITION BY venue_a, venue_b ORDER BY ts)),
r2 AS (SELECT venue_a, venue_b, count(*) AS minutes, sum(ma)::BIGINT AS moves_a, sum(mb)::BIGINT AS moves_b FROM r1 GROUP BY ALL),{_vecm("paired", "f", 5, "venue_a, venue_b")}"""
GATE = "r2.minutes >= 80 AND {0} >= 20 AND {1} >= 20"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["bars_close"] = f"WITH {_paired()} SELECT symbol, venue, ts, close FROM bars"
    q["paired_bars"] = f"WITH {_paired()} SELECT symbol, ts, cex, dex FROM paired"
    q["coverage"] = f"WITH {_coverage()} SELECT * EXCLUDE (window_) FROM cover"
    q["spacing"] = f"WITH {_paired()}, s AS (SELECT symbol, (ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / {HOUR}.0 AS g FROM paired) SELECT symbol, {_r('avg(g)')} AS mean_step, {_r('quantile_cont(g, 0.5)')} AS median_step, count(*) AS paired_minutes FROM s GROUP BY ALL"
    q["moves_premium"] = f"WITH {_paired()}, s AS (SELECT *, coalesce((cex <> lag(cex) OVER w)::INT, 1) AS ma, coalesce((dex <> lag(dex) OVER w)::INT, 1) AS mb FROM paired WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, count(*) AS minutes, sum(ma)::BIGINT AS cex_moves, sum(mb)::BIGINT AS dex_moves, {_r('avg((cex / dex - 1) * 100)')} AS mean_gap_pct FROM s GROUP BY ALL"
    q["session_regimes"] = f"WITH {_paired()}, r AS (SELECT symbol, ts, unnest(['all', CASE WHEN {OPEN} THEN 'open' ELSE 'closed' END]) AS regime FROM paired) SELECT symbol, regime, count(*) AS minutes, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY ALL"
    q["gap_changes"] = f"WITH {_paired()}, s AS (SELECT symbol, ts, ts - lag(ts) OVER w AS g, ln(cex) - lag(ln(cex)) OVER w AS c FROM paired WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, {_r('c')} AS change FROM s WHERE g = {HOUR}"
    q["realign"] = f"WITH {_paired()}, {REALIGN} SELECT symbol, ts, cex, dex FROM moved"
    q["dense_lag_profile"] = f"WITH {_paired()}, {_profile()} SELECT symbol, best_lag, lag, {_r('corr')} AS corr FROM p4 JOIN profile USING (window_, symbol)"
    q["grid_resample"] = f"WITH {_paired()} SELECT symbol, ts // {5 * HOUR} * {5 * HOUR} AS ts, arg_max(cex, paired.ts) AS cex, arg_max(dex, paired.ts) AS dex FROM paired GROUP BY symbol, paired.ts // {5 * HOUR}"
    q["forward_fill"] = f"WITH {_paired()}, {_dense()} SELECT symbol, ts, last_value(cex IGNORE NULLS) OVER w AS cex, last_value(dex IGNORE NULLS) OVER w AS dex FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    kept = f"row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 OR {_uniform(chr(39).join(['concat_ws(', '|', ', 7, symbol, ts)']))} / 4294967296.0 < 0.3"
    q["thin_drop"] = f"WITH {_paired()}, k AS (SELECT *, {kept} AS keep FROM paired) SELECT symbol, ts, cex, dex FROM k WHERE keep"
    q["thin_hold"] = f"WITH {_paired()}, k AS (SELECT *, {kept} AS keep FROM paired) SELECT symbol, ts, cex, last_value(CASE WHEN keep THEN dex END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS dex FROM k"
    q["orders_paired"] = f"WITH {ORDERS} SELECT symbol, count(*) AS minutes, {_r('avg(cex / dex - 1)')} AS premium FROM paired GROUP BY ALL"
    q["vecm_fit"] = f"WITH {_paired()},{_vecm()} SELECT symbol, minutes, {SPEEDS}, leads FROM f"
    q["vecm_lag_sweep"] = f"WITH {_paired()},{LAG_FITS}, u AS ({LAG_UNION}) SELECT symbol, lags, minutes, {SPEEDS}, leads FROM u"
    q["vecm_grid"] = f"WITH {_paired()}, coarse AS (SELECT window_, symbol, paired.ts // {5 * HOUR} * {5 * HOUR} AS ts, arg_max(cex, paired.ts) AS cex, arg_max(dex, paired.ts) AS dex FROM paired GROUP BY window_, symbol, paired.ts // {5 * HOUR}), u AS (SELECT window_, symbol, 'fine' AS grid, ts, cex, dex FROM paired UNION ALL SELECT window_, symbol, 'coarse', ts, cex, dex FROM coarse),{_vecm('u', 'f', 5, 'window_, symbol, grid')}, r AS (SELECT window_, symbol, grid, count(*) AS rows FROM u GROUP BY ALL) SELECT symbol, grid, rows, {SPEEDS}, leads FROM r LEFT JOIN f USING (window_, symbol, grid)"
    q["vecm_sessions"] = f"WITH {SESSIONS} SELECT symbol, minutes_all, minutes_shut, leads_all, leads_shut, {_r('w_all', 4)} AS w_all, {_r('w_shut', 4)} AS w_shut FROM sess2"
    q["vecm_threshold"] = f'WITH {THRESHOLD} SELECT window_ AS "window", symbol, minutes, kept, {SPEEDS}, leads FROM thr2'
    q["vecm_orders"] = f"WITH {ORDERS},{_vecm()} SELECT symbol, minutes, {SPEEDS}, leads FROM f"
    q["hasbrouck"] = f"WITH {_paired()},{_vecm()}, {_shares()} SELECT symbol, {_r('is_low', 4)} AS is_low, {_r('is_high', 4)} AS is_high, {_r('rho')} AS rho FROM shares"
    q["adf_spread"] = f"WITH {_paired()}, {_spread('paired', 'z0')},{_adf('z0', 'az')} SELECT symbol, n, {_r('adf')} AS adf, {_r('half_life', 4)} AS half_life, stationary FROM az"
    q["vector_check"] = f"""WITH {_paired()}, c0 AS (SELECT window_, symbol, regr_slope(ln(cex), ln(dex)) AS beta, regr_slope(ln(dex), ln(cex)) AS rev, count(*) AS n, regr_sxx(ln(cex), ln(dex)) AS sxx, regr_syy(ln(cex), ln(dex)) AS syy, regr_sxy(ln(cex), ln(dex)) AS sxy FROM paired GROUP BY ALL),
pb AS (SELECT paired.*, beta FROM paired JOIN c0 USING (window_, symbol)),{_vecm("paired", "f")},{_vecm("pb", "g", beta="beta")},{_spread("paired", "z0")},{_adf("z0", "az")},{_spread("pb", "z1", "beta")},{_adf("z1", "bz")}
SELECT symbol, {_r("beta")} AS beta, {_r("sqrt((syy - beta * sxy) / ((c0.n - 2) * sxx))")} AS beta_se, {_r("least(beta, 1 / rev)")} AS bracket_low, {_r("az.adf")} AS adf_imposed, {_r("bz.adf")} AS adf_fitted, 1.0 BETWEEN least(beta, 1 / rev) AND greatest(beta, 1 / rev) AS one_bracketed, abs(beta - 1) <= 0.05 AS beta_near_one, f.leads = g.leads AS same_leader
FROM c0 JOIN f USING (window_, symbol) JOIN g USING (window_, symbol) JOIN az USING (window_, symbol) JOIN bz USING (window_, symbol)"""
    q["alignment"] = f"WITH {_alignment()} SELECT symbol, rows_as_collected, rows_realigned, leads_as_collected, leads_realigned, {_r('sd0', 4)} AS sd_as_collected, {_r('sd1', 4)} AS sd_realigned, stationary_as_collected, stationary_realigned, best_lag, {_r('corr_at_zero')} AS corr_at_zero, {_r('corr_at_best')} AS corr_at_best FROM al"
    gate = GATE.format("cex_moves", "dex_moves")
    q["session_panel"] = f"WITH {PANEL} SELECT symbol, regime, r2.minutes, cex_moves, dex_moves, {_r('mean_gap_pct')} AS mean_gap_pct, CASE WHEN {gate} THEN {_r('speed_a')} END AS speed_a, CASE WHEN {gate} THEN {_r('speed_b')} END AS speed_b FROM r2 LEFT JOIN f USING (window_, symbol, regime)"
    gate = GATE.format("moves_a", "moves_b")
    q["venue_matrix"] = f"WITH {MATRIX} SELECT venue_a, venue_b, r2.minutes, moves_a, moves_b, CASE WHEN {gate} THEN {_r('speed_a')} END AS speed_a, CASE WHEN {gate} THEN {_r('speed_b')} END AS speed_b FROM r2 LEFT JOIN f USING (venue_a, venue_b)"
    boot = _bootstrap()
    q["bootstrap_lead"] = f"WITH {boot} SELECT symbol, draws, {_r('lead_share')} AS lead_share, {_r('speed_a_low')} AS speed_a_low, {_r('speed_a_high')} AS speed_a_high, {_r('speed_b_low')} AS speed_b_low, {_r('speed_b_high')} AS speed_b_high, abs(speed_a_high) < abs(speed_b_low) AS speeds_separated FROM boot"
    q["robustness"] = f"""WITH {_coverage()},{_design("paired", "fd")},{_fit("fd", "f")},{_shares()},{_spread("paired", "z0")},{_adf("z0", "az")}{boot[len(_paired()) :]}
SELECT c.symbol, c.paired_minutes, fill_rate, consecutive_share, median_gap_min, max_gap_min, {_r("az.adf")} AS adf, stationary, {SPEEDS}, {_r("is_low", 4)} AS is_low, {_r("is_high", 4)} AS is_high, {_r("rho")} AS rho, {_r("lead_share")} AS lead_share, abs(speed_a_high) < abs(speed_b_low) AS speeds_separated, (w_a > 0.5) = ((is_low + is_high) / 2 > 0.5) AS agree, CASE WHEN c.paired_minutes >= 120 THEN 'ranked' ELSE 'too few paired minutes' END AS verdict
FROM cover c LEFT JOIN shares s ON c.paired_minutes >= 120 AND s.symbol = c.symbol LEFT JOIN az ON c.paired_minutes >= 120 AND az.symbol = c.symbol LEFT JOIN boot ON c.paired_minutes >= 120 AND boot.symbol = c.symbol"""
    q["perm_spearman"] = f"""WITH {CUSTOMERS}, r AS (SELECT id, {_rank("paired_min")} AS rx, {_rank("ratio")} AS ry FROM vr), num AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM r),
s AS (SELECT draw, ry, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 0, draw, id)), id) AS i FROM r, generate_series(1, 20000) g(draw)),
c AS (SELECT draw, avg(num.rx * s.ry) AS m FROM s JOIN num USING (i) GROUP BY ALL), k AS (SELECT avg(rx) AS mx, avg(ry) AS my, stddev_pop(rx) * stddev_pop(ry) AS ss, (avg(rx * ry) - avg(rx) * avg(ry)) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, count(*) AS n FROM r)
SELECT {_r("any_value(rho)")} AS rho, {_r("avg((abs((m - mx * my) / ss) >= abs(rho) - 1e-12)::INT)")} AS p_value, any_value(n) AS n, count(*)::INT AS draws FROM c, k"""
    q["spearman_ratio"] = f"""WITH {CUSTOMERS}, r AS (SELECT *, {_rank("paired_min")} AS rx, {_rank("ratio")} AS ry, {_rank("liquidity")} AS rl, row_number() OVER (ORDER BY ratio DESC, printf('%02d', id)) AS k FROM vr),
c AS (SELECT *, {_rank("paired_min")} AS sx, {_rank("ratio")} AS sy FROM vr JOIN (SELECT id, k FROM r) USING (id) WHERE k > 6),
num AS (SELECT *, printf('%02d', id) AS name, row_number() OVER (ORDER BY printf('%02d', id)) AS i FROM r),
sh AS (SELECT draw, ry, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 0, draw, name)), name) AS i FROM num, generate_series(1, 20000) g(draw)),
pm AS (SELECT draw, avg(num.rx * sh.ry) AS m FROM sh JOIN num USING (i) GROUP BY ALL), pk AS (SELECT avg(rx) * avg(ry) AS mm, stddev_pop(rx) * stddev_pop(ry) AS ss, corr(rx, ry) AS rho FROM r),
pv AS (SELECT avg((abs((m - mm) / ss) >= abs(rho) - 1e-12)::INT) AS p FROM pm, pk),
t AS (SELECT count(*) AS trimmed_tokens, CASE WHEN count(*) >= 10 THEN corr(sx, sy) END AS rho_trimmed FROM c)
SELECT count(*) AS tokens, {_r("any_value(p)")} AS p_value, {_r("corr(rx, ry)")} AS rho, {_r("any_value(rho_trimmed)")} AS rho_trimmed, any_value(trimmed_tokens) AS trimmed_tokens, {_r("corr(rx, rl)")} AS rho_liquidity, {_r("quantile_cont(ratio, 0.5)", 4)} AS median_ratio, {_r("max(ratio)", 2)} AS max_ratio FROM r, t, pv"""
    q["group_buckets"] = f"WITH m AS (SELECT o_custkey, count(*) AS paired_min FROM orders GROUP BY ALL) SELECT c_custkey::VARCHAR AS symbol, paired_min, {_r('1000 / greatest(round(c_acctbal), 1)')} AS ratio, CASE WHEN paired_min < 10 THEN 'dead' WHEN c_nationkey % 3 = 0 THEN 'ranked' ELSE 'thin' END AS \"group\" FROM customer LEFT JOIN m ON c_custkey = o_custkey"
    q["strict_tally"] = "WITH w AS (SELECT l_quantity / max(l_quantity) OVER (PARTITION BY l_partkey) AS w FROM lineitem) SELECT CASE WHEN w > 0.7 THEN 'cex' WHEN w < 0.3 THEN 'dex' WHEN w IS NOT NULL THEN 'unclassified' END AS class, count(*) AS n FROM w GROUP BY ALL"
    q["token_dependence"] = f"WITH {_legs()} SELECT leg, token_pairs, usable_pairs, pairs_below_floor, median_overlap, {_r('median')} AS median, {_r('mean')} AS mean, {_r('low')} AS low, {_r('high')} AS high FROM dep"
    q["pair_spine"] = f'WITH {_legs(True)} SELECT window_ AS "window", leg, sym_a, sym_b, overlap, {_r("corr")} AS corr FROM pairs'
    q["effective_pairs"] = f"WITH {_legs()} SELECT leg, {_r('token_pairs / (1 + (token_pairs - 1) * greatest(0, coalesce(mean, 0)))', 4)} AS effective FROM dep"
    q["sign_test"] = f"""WITH s AS (SELECT user_id, count(*) AS total, count(CASE WHEN value > 100 THEN 1 END) AS led FROM events GROUP BY ALL),
n AS (SELECT user_id, led, total, unnest(generate_series(greatest(led, total - led), total)) AS k FROM s)
SELECT user_id, led, total, {_r("least(1.0, 2 * sum(exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) - total * ln(2))))")} AS p FROM n GROUP BY ALL"""
    q["windows_leadership"] = f"""WITH {_paired(split=True)},{_vecm()}, w AS (SELECT window_, symbol, {_r("w_a", 4)} AS w FROM f)
SELECT symbol, max(CASE WHEN window_ = 'w0' THEN w END) AS w0, max(CASE WHEN window_ = 'w1' THEN w END) AS w1, max(CASE WHEN window_ = 'w2' THEN w END) AS w2, count(w) AS windows_ranked, coalesce(bool_and(w > 0.5), false) AS led_every_window, round(CASE WHEN count(w) >= 2 THEN max(w) - min(w) END, 4) + 0.0 AS spread_across_windows FROM w GROUP BY ALL"""
    q["replication"] = f"WITH {_paired(split=True)},{_vecm()} SELECT x.symbol, {_r('x.speed_a')} AS speed_cex_first, {_r('x.speed_b')} AS speed_dex_first, {_r('y.speed_a')} AS speed_cex_second, {_r('y.speed_b')} AS speed_dex_second, x.leads AND y.leads AS leads_both FROM f x JOIN f y ON x.symbol = y.symbol AND x.window_ = 'w0' AND y.window_ = 'w1'"
    q["replication_drift"] = f"WITH {_paired(split=True)},{_vecm()} SELECT count(*) AS shared, count(CASE WHEN x.leads AND y.leads THEN 1 END) AS led_both, {_r('max(abs(y.w_a - x.w_a))', 4)} AS largest_drift FROM f x JOIN f y ON x.symbol = y.symbol AND x.window_ = 'w0' AND y.window_ = 'w1'"
    q["lead_tally"] = f'WITH {_paired(split=True)},{_vecm()} SELECT window_ AS "window", count(CASE WHEN leads THEN 1 END) AS led, count(*) AS total FROM f GROUP BY ROLLUP (window_) HAVING count(*) > 0'
    line = lambda y: f"CASE WHEN c1.k IS NULL THEN c0.{y} ELSE c0.{y} + (v - c0.k) / (c1.k - c0.k) * (c1.{y} - c0.{y}) END"
    q["staleness_risk"] = f"""WITH {_coverage(True)}, cv AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM (SELECT k::DOUBLE AS k, dr::DOUBLE AS dr, ho::DOUBLE AS ho FROM {CURVE} t(k, dr, ho))), x AS (SELECT window_, symbol, fill_rate, least(greatest(fill_rate, 0.05), 1.0) AS v FROM cover)
SELECT window_ AS "window", symbol, fill_rate, {_r(line("dr"))} AS false_lead_drop, {_r(line("ho"))} AS false_lead_hold FROM x JOIN cv c0 ON v >= c0.k LEFT JOIN cv c1 ON c1.i = c0.i + 1 WHERE c1.k IS NULL OR v < c1.k"""
    q["floor_summary"] = f"WITH {THRESHOLD} SELECT window_ AS \"window\", CASE WHEN kept THEN 'kept' WHEN w_a IS NOT NULL THEN 'below' ELSE 'refused' END AS band, count(*) AS series, count(CASE WHEN leads THEN 1 END) AS leaning, {_r('quantile_cont(w_a, 0.5)', 4)} AS median_w, min(minutes) AS least, max(minutes) AS most, count(CASE WHEN w_a < 0 OR w_a > 1 THEN 1 END) AS outside FROM thr2 GROUP BY ALL"
    kind = lambda w, c: {"cex": f"{w} > 0.7", "dex": f"{w} < 0.3", "unclassified": f"{w} BETWEEN 0.3 AND 0.7"}[c]
    tallies = ", ".join(f"count(CASE WHEN {kind(w, c)} THEN 1 END) AS {c}_{side}" for w, side in (("w0", "as_collected"), ("w1", "realigned")) for c in ("cex", "dex", "unclassified"))
    q["alignment_summary"] = f"""WITH {_alignment(True)} SELECT window_ AS "window", count(*) AS series, count(CASE WHEN w1 > w0 THEN 1 END) AS moved_towards, {_r("max(CASE WHEN w1 < w0 THEN w0 - w1 END)", 4)} AS largest_against, count(CASE WHEN w0 > 0.5 AND w1 <= 0.5 THEN 1 END) AS leads_lost, {tallies},
{_r("quantile_cont(w0, 0.5)", 4)} AS median_w_as_collected, {_r("quantile_cont(w1, 0.5)", 4)} AS median_w_realigned, {_r("quantile_cont(sd0, 0.5)", 4)} AS median_sd_as_collected, {_r("quantile_cont(sd1, 0.5)", 4)} AS median_sd_realigned FROM al WHERE w0 IS NOT NULL AND w1 IS NOT NULL GROUP BY ALL"""
    picks = ", ".join(f"{_r(f'max(CASE WHEN lags = {n} THEN u.w_a END)', 4)} AS w_lags_{n}" for n in (1, 3, 5, 10))
    q["pivot_weights"] = f"""WITH {_paired()},{LAG_FITS}, u AS ({LAG_UNION}), coarse AS (SELECT window_, symbol, paired.ts // {5 * HOUR} * {5 * HOUR} AS ts, arg_max(cex, paired.ts) AS cex, arg_max(dex, paired.ts) AS dex FROM paired GROUP BY window_, symbol, paired.ts // {5 * HOUR}),{_vecm("coarse", "fc")}, names AS (SELECT DISTINCT symbol FROM paired)
SELECT symbol, {_r("any_value(f5.w_a)", 4)} AS w_grid_fine, {_r("any_value(fc.w_a)", 4)} AS w_grid_coarse, {picks} FROM names LEFT JOIN u USING (symbol) LEFT JOIN f5 USING (symbol) LEFT JOIN fc USING (symbol) GROUP BY symbol"""
    gate = GATE.format("cex_moves", "dex_moves")
    pick = lambda x, e: _r(f"max(CASE WHEN regime = '{x}' THEN {e} END)", 4)
    wide = ", ".join(f"{pick(x, e)} AS {n}_{x}" for n, e in (("gap", "mean_gap_pct"), ("w", f"CASE WHEN {gate} THEN w_a END")) for x in ("all", "open", "closed"))
    q["pivot_regimes"] = f"WITH {PANEL} SELECT symbol, {wide} FROM r2 LEFT JOIN f USING (window_, symbol, regime) GROUP BY symbol"
    q["pivot_lags"] = f"WITH {_paired()},{LAG_FITS}, u AS ({LAG_UNION}) SELECT symbol, {', '.join(f'bool_or(CASE WHEN lags = {n} THEN leads END) AS leads_{n}' for n in (1, 3, 5, 10))} FROM u GROUP BY ALL"
    q["lag_flips"] = f"WITH {_paired()},{LAG_FITS}, u AS ({LAG_UNION}) SELECT symbol, count(DISTINCT leads) AS leaders, count(*) AS orders FROM u GROUP BY ALL"
    q["closed_share"] = f"WITH {_paired()} SELECT symbol, {_r(f'avg(CASE WHEN {OPEN} THEN 0.0 ELSE 1.0 END)')} AS closed_share FROM paired GROUP BY ALL"
    q["regime_crossing"] = f"WITH {SESSIONS} SELECT symbol, {_r('w_all', 4)} AS w_all, {_r('w_shut', 4)} AS w_shut FROM sess2 WHERE (w_all > 0.5) <> (w_shut > 0.5)"
    q["crossing_summary"] = f"WITH {SESSIONS} SELECT count(*) AS crossings, count(CASE WHEN w_all BETWEEN 0.3 AND 0.7 THEN 1 END) + count(CASE WHEN w_shut BETWEEN 0.3 AND 0.7 THEN 1 END) AS in_band FROM sess2 WHERE (w_all > 0.5) <> (w_shut > 0.5)"
    q["median_split"] = f"WITH {_paired(split=True)}, s AS (SELECT window_, symbol, (ts - lag(ts) OVER (PARTITION BY window_, symbol ORDER BY ts)) / {HOUR}.0 AS g FROM paired), m AS (SELECT window_, symbol, avg(g) AS mean_step FROM s GROUP BY ALL) SELECT window_ AS \"window\", symbol, {_r('mean_step')} AS mean_step, CASE WHEN mean_step <= quantile_cont(mean_step, 0.5) OVER (PARTITION BY window_) THEN 'low' ELSE 'high' END AS half FROM m"
    say = lambda f: f"strftime(make_timestamp({f}(ts) * 1000000), '%-d %B %H:%M')"
    q["pass_window"] = f'WITH {_paired(split=True)} SELECT window_ AS "window", {say("min")} AS begins, {say("max")} AS ends FROM paired GROUP BY ALL'
    q["topup_anti"] = 'SELECT DISTINCT event_type AS "window", user_id AS symbol FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.value > 50 AND b.event_type = a.event_type AND b.user_id = a.user_id)'
    q["semi_ranked"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)"
    q["key_sets"] = "WITH a AS (SELECT c_nationkey::BIGINT AS k FROM customer), b AS (SELECT s_nationkey::BIGINT AS k FROM supplier), u AS ((SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL (SELECT 'left', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) UNION ALL (SELECT 'right', k FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a))) SELECT part, k, count(*) AS n FROM u GROUP BY ALL"
    q["order_contract"] = f"WITH {_paired()} SELECT (SELECT count(*) FROM (SELECT symbol, ts FROM paired GROUP BY ALL HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) FROM (SELECT ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM paired) WHERE g <= 0) AS disorder, (SELECT count(*) FROM paired) AS rows"
    q["top_gaps"] = f'WITH {_coverage(True)} SELECT window_ AS "window", symbol, max_gap_min FROM cover ORDER BY max_gap_min DESC, symbol, window_ LIMIT 5'
    q["wide_windows"] = f"WITH {_coverage(True)} SELECT symbol, {', '.join(f'max(CASE WHEN window_ = {chr(39)}w{i}{chr(39)} THEN paired_minutes END) AS w{i}' for i in range(3))} FROM cover GROUP BY ALL"
    q["json_layouts"] = "SELECT o_orderkey AS k, unnest(['a', 'pool', 'b', 'c']) AS venue, epoch_us(o_orderdate) // 1000000 AS ts, o_totalprice::DECIMAL(18, 2)::DOUBLE AS close FROM orders"
    q["page_overlap"] = "SELECT user_id AS k, epoch_us(ts) // 86400000000 * 86400 AS ts, arg_max(value, event_id) AS value FROM events GROUP BY user_id, epoch_us(events.ts) // 86400000000"
    q["universe_screen"] = "WITH t AS (SELECT upper(substr(p_brand, 1, 8)) || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'X' ELSE 'Y' END AS base, p_retailprice * 100 AS v FROM part) SELECT base AS symbol, base || '_USDT' AS currency_pair, round(v)::BIGINT AS cex_volume_24h FROM t WHERE base LIKE '%X' AND v >= 4000"
    q["deepest_pools"] = f"WITH {POOLS} SELECT symbol, base_address AS mint, pool, dex, round(liquidity)::BIGINT AS dex_liquidity, round(volume)::BIGINT AS dex_volume_24h FROM best WHERE k = 1"
    q["impostors"] = f"WITH {POOLS} SELECT symbol, base_address AS impostor_mint, arg_max(dex, liquidity) AS dex, max(liquidity) AS claimed_liquidity_usd FROM pools WHERE chain = 'solana' AND NOT starts_with(base_address, 'Xs') GROUP BY ALL"
    q["registry_check"] = f"""WITH {POOLS}, mine AS (SELECT symbol, base_address AS mint FROM best WHERE k = 1), i AS (SELECT 'T' || s_nationkey || 'X' AS symbol, 'Xs' || min(s_suppkey) AS issuer_mint FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey), r AS (SELECT 'Xs' || s_suppkey AS mint, s_name AS registry_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT symbol, mint, issuer_mint IS NOT NULL AS issuer_lists_symbol, issuer_mint, coalesce(issuer_mint = mint, false) AS issuer_mint_matches, registry_name IS NOT NULL AS in_registry, registry_name, coalesce(issuer_mint = mint, false) AND registry_name IS NOT NULL AS confirmed FROM mine LEFT JOIN i USING (symbol) LEFT JOIN r USING (mint)"""
    q["issuer_list"] = "SELECT 'T' || s_nationkey || 'X' AS symbol, 'Xs' || arg_max(s_suppkey, s_suppkey % 4 * 1000000 + s_suppkey) AS address FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey"
    q["pool_search"] = f"WITH {POOLS} SELECT symbol, chain, dex, pool, base_address, CASE WHEN liquidity > 1000 THEN liquidity ELSE 0 END AS liquidity, volume FROM pools"
    q["universe_build"] = f"WITH {POOLS}, t AS (SELECT 'T' || c_nationkey || 'X' AS symbol, round(sum(abs(c_acctbal)))::BIGINT AS v FROM customer GROUP BY c_nationkey) SELECT symbol, symbol || '_USDT' AS cex_pair, v AS cex_volume_24h, base_address AS mint, pool, dex, round(liquidity)::BIGINT AS dex_liquidity, round(volume)::BIGINT AS dex_volume_24h FROM t JOIN best USING (symbol) WHERE k = 1 AND v >= 20000"
    q["group_medians"] = f"SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_cont(l_quantity, 0.5) AS median_quantity, {_r('stddev_samp(l_discount)')} AS sd_discount, {_r('covar_samp(l_quantity, l_discount)')} AS cov FROM lineitem GROUP BY ALL"
    q["rolling_sums"] = f"WITH {_paired()}, s AS (SELECT symbol, ts, sum(cex) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s, row_number() OVER w AS i FROM paired WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, {_r('s', 4)} AS block_sum FROM s WHERE i >= 10"
    q["sets_disjoint"] = "SELECT c_mktsegment, NOT bool_or(c_custkey % 40 + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END IN (SELECT o_custkey % 40 FROM orders)) AS disjoint FROM customer GROUP BY ALL"
    q["mirror_drift"] = "SELECT n_name AS name, sha256(n_name) AS sha_a, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE sha256(lower(n_name)) END AS sha_b FROM nation WHERE n_nationkey % 5 = 0 OR (n_nationkey % 7 = 0 AND lower(n_name) <> n_name)"
    q["text_flatten"] = r"SELECT doc_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS flat_md5 FROM documents"
    q["phrase_presence"] = r"SELECT doc_id, regexp_matches(text, '(^|[^0-9.])2\.0([^0-9]|$)') AS has_2_0, contains(text, 'the') AS has_the FROM documents"
    part, number = r"[\p{L}\p{N}_.]", r"(\p{Nd}+(?:\.\p{Nd}+)?)(?:[^\p{Nd}a-zA-Z]|$)"
    tokens = lambda runs, first: f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{runs}'), lambda x: regexp_extract(x, '{first}{number}', 1)), lambda x: x <> '')))"
    plain, minus = tokens(f"{part}+", "^"), tokens(f"(?:[^{part[1:-1]}-]|^)?--+{part}*|(?:^|[^{part[1:-1]}-])-{part}*", "^[^-]?-+")
    q["number_tokens"] = f"SELECT doc_id, len({plain}) AS n, array_to_string({plain}, ',') AS numbers, array_to_string(list_transform({minus}, lambda x: '-' || x), ',') AS signed FROM documents"
    q["markdown_table"] = "SELECT doc_id, unnest([0, 1]) AS row, unnest([doc_id::VARCHAR, n_chars::VARCHAR]) AS id, unnest([lang, source]) AS lang FROM documents"
    q["html_cells"] = "SELECT event_id, event_type, value FROM events"
    q["page_links"] = r"SELECT page_id, len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>')) AS paragraphs, 0 AS cells FROM pages"
    q["html_report"] = """SELECT '<!doctype html><html><head><title>Report</title></head><body><h1>Report</h1><h2>Nations</h2><table><tr><th>key</th><th>name</th></tr>' || string_agg(CASE WHEN n_regionkey = 0 THEN '<tr class="tone">' ELSE '<tr>' END || '<td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey)
|| '</table><h2>Regions</h2><table><tr><th>name</th></tr>' || (SELECT string_agg('<tr><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) FROM region) || '</table></body></html>' AS html FROM nation"""
    q["spelled_numbers"] = f"SELECT p_partkey, coalesce(map_extract_value(MAP {SPELLED}, p_size::INT), p_size::VARCHAR) AS spelled FROM part"
    q["prose_blocks"] = r"""WITH b AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+$', '', 'g') AS block FROM documents)
SELECT doc_id, count(CASE WHEN block <> '' AND NOT (left(block, 1) IN ('#', '|', '-', '*', '>') OR starts_with(block, '{{<') OR starts_with(block, '```') OR contains(block, chr(10) || '|') OR contains(block, chr(10) || '```')) THEN 1 END) AS prose, count(*) AS blocks FROM b GROUP BY ALL"""
    q["compound_rejoin"] = r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '(\w)(\w\w) ', '\1-' || chr(10) || '\2 ', 'g'), '(\w)-\n(\w)', '\1-\2', 'g')) AS joined_md5 FROM conversations"
    gone = lambda x: rf"regexp_replace({x}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', '', 'g')"
    q["link_heal"] = f"""WITH t AS (SELECT doc_id, string_split('see [x](http://a.b/' || doc_id || chr(10) || '/(c ' || lang || ') and (' || source || ' d) ' || coalesce(text, ''), '](') AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, parts FROM t),
h AS (SELECT doc_id, i, CASE WHEN i = 1 THEN part WHEN contains(part, ')') THEN {gone("split_part(part, ')', 1)")} || substr(part, strpos(part, ')')) WHEN contains(array_to_string(list_slice(parts, i + 1, -1), ''), ')') THEN {gone("part")} ELSE part END AS part FROM p),
j AS (SELECT doc_id, string_agg(part, '](' ORDER BY i) AS healed FROM h GROUP BY doc_id) SELECT doc_id, substr(healed, 1, 40) AS head, md5(healed) AS healed_md5 FROM j"""
    q["spoken_dates"] = "SELECT o_orderkey, strftime(o_orderdate, '%-d %B') AS spoken FROM orders"
    some = lambda words: "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(text), w)), ',')"
    q["ascii_scan"] = rf"SELECT doc_id, NOT regexp_matches(text, '[^\x00-\x7F]') AS ascii, contains(text, chr(8212))::INT + contains(text, chr(8211))::INT AS dashes, {some(['normalize', 'summarize', 'analyze', 'behavior', 'labeled', 'modeling'])} AS american, {some(['exactly', 'significantly', 'notably', 'clearly'])} AS filler FROM documents"
    q["fenced_commands"] = r"""WITH t AS (SELECT conv_id, turn, 'run tool ' || role || chr(10) || '```' || chr(10) || 'tool hidden' || turn || chr(10) || '```' || chr(10) || 'then tool t' || (conv_id % 7) || ' ' || coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), 'tool[ \t]+([A-Za-z0-9_./-]+)', 1)) AS argument FROM t) SELECT conv_id, turn, argument FROM c WHERE argument NOT IN (SELECT role FROM conversations)"""
    q["claims_check"] = f"WITH {CLAIMS} SELECT * FROM res"
    q["claims_tally"] = f"WITH {CLAIMS} SELECT surface, count(*) AS checks, count(CASE WHEN drifted OR missing THEN 1 END) AS failures FROM res GROUP BY ALL"
    q["direction_check"] = "WITH e AS (SELECT event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type AS surface, 'above' AS label, m > CASE WHEN event_type = 'error' THEN 1000.0 ELSE 50.0 END AS holds, m > 50 AS said, (m > 50) = (m > CASE WHEN event_type = 'error' THEN 1000.0 ELSE 50.0 END) AS agrees FROM e"
    q["table_compare"] = "SELECT n_nationkey::VARCHAR AS row, 'name' AS col, unnest([n_name, lower(n_name)]) AS value, unnest(['left', 'right']) AS side FROM nation WHERE n_regionkey = 1"
    return q
