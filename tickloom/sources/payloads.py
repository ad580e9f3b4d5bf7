"""Layouts of the venues' payloads.  Fields are taken by position in the documented layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "array<array<string>>"
POOL = "struct<data:struct<attributes:struct<ohlcv_list:array<array<double>>>>>"
WRAPPED = "struct<result:struct<list:array<array<string>>>>"
ISSUER = "struct<nodes:array<struct<symbol:string,deployments:array<struct<network:string,address:string>>>>,page:struct<hasNextPage:boolean>>"
SEARCH = "struct<pairs:array<struct<chainId:string,dexId:string,pairAddress:string,baseToken:struct<symbol:string,address:string>,liquidity:struct<usd:double>,volume:struct<h24:double>>>>"


def _bars(frame: DataFrame, rows: Column, close: int, unit: int) -> DataFrame:
    """(other columns, ts, close): stamps in seconds."""
    keep = [c for c in frame.columns if c != "payload"]
    one = frame.select(*keep, F.explode(rows).alias("_r"))
    ts = F.floor(F.element_at("_r", 1).cast("double").cast("long") / unit)
    return one.select(*keep, ts.cast("long").alias("ts"), F.element_at("_r", close + 1).cast("double").alias("close"))


def exchange_a(frame: DataFrame) -> DataFrame:
    """[ts, quote volume, close, high, low, open, base volume, closed], seconds."""
    return _bars(frame, F.from_json("payload", ROWS), 2, 1)


def pool(frame: DataFrame) -> DataFrame:
    """data.attributes.ohlcv_list of [ts, open, high, low, close, volume], seconds."""
    return _bars(frame, F.from_json("payload", POOL)["data"]["attributes"]["ohlcv_list"], 4, 1)


def exchange_b(frame: DataFrame) -> DataFrame:
    """result.list of [ts, open, high, low, close, ..], milliseconds, newest first."""
    return _bars(frame, F.from_json("payload", WRAPPED)["result"]["list"], 4, 1000)


def exchange_c(frame: DataFrame) -> DataFrame:
    """The rows of exchange B without wrapper."""
    return _bars(frame, F.from_json("payload", ROWS), 4, 1000)


def issuer_list(frame: DataFrame, network: str = "solana", order: str = "page_no") -> DataFrame:
    """(symbol, address) of deployments on a network; upper-case symbols, the last one wins."""
    node = frame.select(order, F.posexplode(F.from_json("payload", ISSUER)["nodes"]).alias("_i", "_n"))
    dep = node.select(order, "_i", F.upper(F.col("_n.symbol")).alias("symbol"), F.posexplode("_n.deployments").alias("_j", "_d")).where(F.col("_d.network") == network)
    return dep.groupBy("symbol").agg(F.max_by("_d.address", F.struct(order, "_i", "_j")).alias("address"))


def search_pairs(frame: DataFrame) -> DataFrame:
    """(other columns, chain, dex, pool, base_symbol, base_address, liquidity, volume) of a pool search."""
    keep = [c for c in frame.columns if c != "payload"]
    p = frame.select(*keep, F.explode(F.from_json("payload", SEARCH)["pairs"]).alias("p"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.select(*keep, F.col("p.chainId").alias("chain"), F.col("p.dexId").alias("dex"), F.col("p.pairAddress").alias("pool"), F.col("p.baseToken.symbol").alias("base_symbol"), F.col("p.baseToken.address").alias("base_address"), zero("p.liquidity.usd").alias("liquidity"), zero("p.volume.h24").alias("volume"))


def screen_universe(tickers: DataFrame, least_volume: float = 20000.0) -> DataFrame:
    """Tickers (currency_pair, quote_volume) of tokens quoted in USDT whose symbol ends in X, by volume."""
    base = F.regexp_replace("currency_pair", "_USDT$", "")
    volume = F.coalesce(F.expr("nullif(quote_volume, '')").cast("double"), F.lit(0.0))
    good = F.col("currency_pair").endswith("_USDT") & base.endswith("X") & (volume >= least_volume)
    return tickers.where(good).select(base.alias("symbol"), "currency_pair", F.round(volume).cast("long").alias("cex_volume_24h"))


def genuine(pools: DataFrame, prefix: str, chain: str = "solana") -> Column:
    return (F.col("chain") == chain) & (F.upper("base_symbol") == F.upper("symbol")) & F.col("base_address").startswith(prefix)


def deepest_pools(pools: DataFrame, prefix: str) -> DataFrame:
    """For each symbol its genuine pool with the most liquidity; of equals the first by address."""
    best = pools.where(genuine(pools, prefix)).groupBy("symbol").agg(F.min(F.struct((-F.col("liquidity")).alias("l"), "pool", "dex", "base_address", "volume")).alias("b"))
    return best.select("symbol", F.col("b.base_address").alias("mint"), "b.pool", "b.dex", F.round(-F.col("b.l")).cast("long").alias("dex_liquidity"), F.round("b.volume").cast("long").alias("dex_volume_24h"))


def impostors(pools: DataFrame, prefix: str, chain: str = "solana") -> DataFrame:
    """Pools that carry a symbol on the chain without the issuer's address prefix."""
    bad = (F.col("chain") == chain) & (F.upper("base_symbol") == F.upper("symbol")) & ~F.col("base_address").startswith(prefix)
    return pools.where(bad).groupBy("symbol", F.col("base_address").alias("impostor_mint")).agg(F.max_by("dex", "liquidity").alias("dex"), F.max("liquidity").alias("claimed_liquidity_usd")).orderBy(F.desc("claimed_liquidity_usd"), "symbol", "impostor_mint")


def verify_mints(universe: DataFrame, issuer: DataFrame, registry: DataFrame) -> DataFrame:
    """Each mint against the issuer's list and a second registry (address, name); flags are never NULL."""
    i = issuer.select("symbol", F.col("address").alias("issuer_mint"))
    r = registry.select(F.col("address").alias("mint"), F.col("name").alias("registry_name")).dropDuplicates(["mint"])
    match = F.coalesce(F.col("issuer_mint") == F.col("mint"), F.lit(False))
    listed, known = F.col("issuer_mint").isNotNull(), F.col("registry_name").isNotNull()
    return universe.select("symbol", "mint").join(i, "symbol", "left").join(r, "mint", "left").select("symbol", "mint", listed.alias("issuer_lists_symbol"), "issuer_mint", match.alias("issuer_mint_matches"), known.alias("in_registry"), "registry_name", (match & known).alias("confirmed"))
