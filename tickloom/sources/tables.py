"""Series and tables at rest: CSV by window, Parquet partitioned by window, snapshots, top-ups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAIRED


def read_series_csv(spark: SparkSession, path: str, window: str) -> DataFrame:
    """Paired rows of a folder with one CSV for each symbol; the file's stem is the symbol.  Columns
    are taken by header name; files named coverage or universe are left out."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema("ts BIGINT, cex DOUBLE, dex DOUBLE").csv(f"{path}/*.csv", pathGlobFilter="[A-Z]*.csv")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(F.lit(window).alias("window"), stem.alias("symbol"), "ts", "cex", "dex")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table by header name with declared types; empty cells are NULL."""
    names = spark.read.option("header", True).csv(path).columns
    types = {f.split()[0].strip('`"'): f.split(None, 1)[1] for f in schema.split(", ")}
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{n}` AS {types[n]})").alias(n) for n in names if n in types])


def write_csv(df: DataFrame, path: str, keys: list[str], digits: int | None = None) -> None:
    """One sorted CSV, for small result tables."""
    if digits is not None:
        df = df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_window(df: DataFrame, path: str) -> None:
    """Replaces the windows in df and leaves all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(path)


def read_windows(spark: SparkSession, path: str, schema: str = PAIRED) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def missing_symbols(wanted: DataFrame, have: DataFrame, keys: list[str] = ("window", "symbol")) -> DataFrame:
    """Rows of wanted that a top-up still has to fetch."""
    return wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")


def top_up(df: DataFrame, path: str, cover: DataFrame | None = None, cover_path: str | None = None) -> None:
    """Appends only series that are not there yet, and the rows of cover for the same series to its table."""
    spark = df.sparkSession
    have = read_windows(spark, path).select("window", "symbol").distinct()
    if cover is not None:
        # the coverage goes first: it is decided by what the series lacked before
        missing_symbols(cover, have).write.mode("append").partitionBy("window").parquet(cover_path)
    missing_symbols(df, have).write.mode("append").partitionBy("window").parquet(path)


def window_universe(spark: SparkSession, path: str, window: str, committed: DataFrame) -> DataFrame:
    """The universe a window was collected against: its own snapshot if it has one, else the committed one."""
    try:
        own = spark.read.parquet(f"{path}/window={window}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return committed
    return own


def write_universe(df: DataFrame, path: str, window: str) -> None:
    """A window's own snapshot; the committed universe is another table and stays as it is."""
    df.write.mode("overwrite").parquet(f"{path}/window={window}")


def mirror_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies every file of a folder that the other lacks or has otherwise, byte for byte; returns those
    (name, sha_a, sha_b) as they were before.  Files are small result tables, listed on the driver."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    empty = spark.createDataFrame([], "name string, sha string")
    have = file_digests(spark, target) if len(fs.listStatus(folder)) else empty
    stale = drifted_files(file_digests(spark, source), have).where("sha_a is not null").collect()
    for r in stale:
        one = jvm.org.apache.hadoop.fs.Path(f"{source}/{r['name']}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, fs, jvm.org.apache.hadoop.fs.Path(f"{target}/{r['name']}"), False, True, conf)
    return spark.createDataFrame([tuple(r) for r in stale], "name string, sha_a string, sha_b string")


def drifted_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files (name, sha) that differ between two mirrors; NULL where one lacks it."""
    x, y = a.select("name", F.col("sha").alias("sha_a")), b.select("name", F.col("sha").alias("sha_b"))
    return x.join(y, "name", "full").where(~F.col("sha_a").eqNullSafe(F.col("sha_b")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha) of every file in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")
