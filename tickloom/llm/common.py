"""Shared pieces: scratch tables in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_HELD: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives memory that a worker process has freed back to the system; called at a task's end, as
    the worker stays for later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """Says that a worker process now fills this cache: those of other operators are emptied, so a
    worker that serves several stages holds one cache at a time."""
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = clear


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Inside, Spark hands whole texts to Python in record batches of so many rows: the default of 10000
    is meant for narrow rows.  Work must be done inside, as by materialize(); the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset, a local one if Spark runs in one
    process; on a cluster, where executors could not read it, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and any
    executor can reread it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df written with two columns more: _row, a number no other row has, and _content, a hash of the
    row that does not depend on how rows are dealt out.  Columns without an order (maps) are not hashed."""
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return materialize(df.withColumns({"_content": F.xxhash64(*plain), "_row": F.monotonically_increasing_id()}), name)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A group with at least this share of the rows is heavy; so there are at most as many heavy groups.
HEAVY_GROUPS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, how_many: int = HEAVY_GROUPS) -> DataFrame:
    """rows joined to the one row of groups that has their key, where groups has the number ``n`` of rows
    of each key out of ``total``.

    Groups with more than total / how_many rows are broadcast; there are fewer than ``how_many`` of
    them, whatever the data.  So no task gets more than its share and one such group, however the rest is dealt."""
    heavy = groups.where(F.col(n) * how_many > total)
    light = groups.where(F.col(n) * how_many <= total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a string, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, groups: list[str], order: list[str], out: str = "rank", weight: str | None = None, total: str | None = None) -> DataFrame:
    """Adds ``out``: the number of rows (or the sum of ``weight``) before this one in its group.

    One range exchange deals rows out by (groups, order), so that a group of any size spreads over
    many tasks; ranks inside a partition come from a window, and offsets from a running sum over
    the table of partition totals, which has one row per partition and group.  ``order`` must
    make rows distinct within a group for the ranks to be reproducible.  ``total`` names a column
    for the whole group's sum.  The frame should be slim: it is written once.
    """
    spark = df.sparkSession
    keys = [*groups, *order]
    ranged = materialize(df.repartitionByRange(partitions(spark), *keys).withColumn("_p", F.spark_partition_id()), "ranged")
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    sums = ranged.groupBy("_p", *groups).agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*groups).orderBy("_p")
    cols = [F.col(g).alias(f"_g_{g}") for g in groups]
    before = sums.select(F.col("_p").alias("_q"), *cols, (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), *([F.sum("_sum").over(Window.partitionBy(*groups)).alias(total)] if total else []))
    on = F.col("_p") == F.col("_q")
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy("_p", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(amount).over(inside) - amount)
    joined = local.join(before, on)
    return joined.withColumn(out, F.col("_before") + F.col("_local")).drop("_p", "_q", "_before", "_local", *[f"_g_{g}" for g in groups])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected edges: one row (node, component) per node of an edge,
    component being the smallest node reachable.

    Alternating large-star and small-star rounds; each is a partial aggregate (the smallest
    neighbour) and a join back, so a hub with very many neighbours is never gathered in one task.
    Rounds grow with the logarithm of a component's size, and every round is written to the
    shared folder.  Self loops and repeated edges are allowed; null ends are dropped.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, last = None, e
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        seen = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(least, "u")
        e = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(e, "edges")
        discard(last)
        last = e
