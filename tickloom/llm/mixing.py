"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, materialize, unused, words_in


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """sizes: (source, source_size).  Adds target.

    Sources by code point, nulls last, get ``weights`` in turn, over and over.  Together they
    share ``share`` times all sizes in proportion to weight, none above ``cap`` times its own size.
    Excess goes to the others by weight until none is above: in order of cap/weight, the sources
    that reach their cap are a prefix, so running sums over the (one row per source) table find it.
    If the caps together are below the share, every source gets its cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    one = Window.partitionBy(F.lit(1))
    spot = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("_w", F.element_at(cycle, (spot % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by = one.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_c0": F.coalesce(F.sum("_cap").over(by), F.lit(0.0)), "_w0": F.coalesce(F.sum("_w").over(by), F.lit(0.0)), "_t": F.sum("source_size").over(one) * F.lit(float(share)), "_ws": F.sum("_w").over(one)})
    s = s.withColumn("_capped", F.col("_cap") * (F.col("_ws") - F.col("_w0")) <= (F.col("_t") - F.col("_c0")) * F.col("_w"))
    # once a source is not capped, none after it is
    s = s.withColumns({"_free_c": F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(one), "_free_w": F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0.0)).over(one)})
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise((F.col("_t") - F.col("_free_c")) * F.col("_w") / F.col("_free_w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each row of docs goes into the mix: (id, source, size, source_size, target, copies, taken).

    A document's expected copies are target / source_size.  Documents of a source stand in order
    of size and id; the running sum of expected copies plus one random offset for the source (a
    hash of its name and the seed, so that reruns agree) crosses so many integers at a document,
    and it is emitted once for each.  Order by size makes the words taken come within about one
    long document of the target.  Copies are the floor or ceiling of target / source_size.

    Size is the number of words (null text: 0).  Null is a source like any other.  Repeated and
    null ids are rows of their own; those of equal source and size are interchangeable here.  ``keys``
    are columns that tell them apart (as of numbered()): they decide after the id, and are kept.  A
    source of size 0 has target 0 and gives no copies.  An empty table gives no rows.  Only the
    columns named are read.
    """
    slim = docs.select(*keys, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    slim = materialize(slim, "sizes")  # texts are read once; dealing rows out samples them first
    ranked = global_rank(slim, ["source"], ["size", "doc_id", *keys], "_rank")
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, cap).select(F.col("source").alias("_s"), "source_size", "target")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00null")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    crossed = F.floor((F.col("_rank") + 1) * F.col("_e") + F.col("_u")) - F.floor(F.col("_rank") * F.col("_e") + F.col("_u"))
    out = joined.withColumns({"_e": rate, "_u": offset}).withColumn("copies", crossed.cast("long"))
    return out.select(*keys, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row of docs as often as ``mixed`` says, all columns of docs.
    Documents with no copies go.  Columns of docs may have any names.  ``id_col`` must be unique and not null in docs: doc_id, or one of
    the ``keys`` that mix() kept."""
    key, n, i = (unused(docs, c) for c in ("_id", "_n", "_i"))
    copies = mixed.where("copies > 0").select(F.col("doc_id" if id_col not in mixed.columns else id_col).alias(key), F.col("copies").alias(n))
    return docs.join(copies, docs[id_col] == F.col(key)).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
