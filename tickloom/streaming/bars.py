"""Bars and pairs from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_stream(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """(window, symbol, ts, cex, dex) for buckets in which both venues traded, from a streaming frame
    (window, symbol, venue 0/1, at TIMESTAMP, seq, value).

    One stateful aggregate does both the bars and the pairing.  A bucket is emitted once the
    watermark has passed it; ticks later than ``late`` are dropped."""
    last = lambda v: F.max_by(F.when(F.col("venue") == v, F.col("value")), F.when(F.col("venue") == v, F.struct("at", "seq")))
    agg = ticks.where("value > 0").withWatermark("at", late).groupBy("window", "symbol", F.window("at", width).alias("bucket")).agg(last(0).alias("cex"), last(1).alias("dex"))
    return agg.where("cex is not null and dex is not null").select("window", "symbol", F.unix_seconds("bucket.start").alias("ts"), "cex", "dex")
