"""Column sets and settings of the series, tables and results.

FIXED VALUES: thresholds that are part of the results' meaning.
"""

PAIRED = "window STRING, symbol STRING, ts BIGINT, cex DOUBLE, dex DOUBLE"
BARS = "window STRING, symbol STRING, venue STRING, ts BIGINT, close DOUBLE"
UNIVERSE = "symbol STRING, cex_pair STRING, cex_volume_24h BIGINT, mint STRING, pool STRING, dex STRING, dex_liquidity BIGINT, dex_volume_24h BIGINT"
COVERAGE = "symbol STRING, cex_minutes BIGINT, dex_minutes BIGINT, window_minutes BIGINT, paired_minutes BIGINT, fill_rate DOUBLE, median_gap_min BIGINT, max_gap_min BIGINT, consecutive_share DOUBLE, first_ts BIGINT, last_ts BIGINT"

MINUTE = 60
LAGS = 5
SWEEP_LAGS = (1, 3, 5, 10)
MIN_PAIRED = 120
PANEL_ROWS, PANEL_MOVES, REGIME_ROWS = 80, 20, 30
MIN_OVERLAP = 60
MIN_SPREAD_ROWS = 20
DEAD_BELOW = 10
TINY = 1e-12
ADF_CRITICAL = {0.01: -2.567, 0.05: -1.941, 0.10: -1.617}
SESSION_OPEN, SESSION_CLOSE = 13 * 60 + 30, 20 * 60
STRICT_LOW, STRICT_HIGH = 0.3, 0.7
CLAIM_TOLERANCE = 0.011
BETA_TOLERANCE = 0.05


def vecm_minimum(lags: int) -> int:
    """Paired rows that an error-correction fit needs."""
    return 4 * lags + 20


def adf_minimum(lags: int) -> int:
    return lags + 20
