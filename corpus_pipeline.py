"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import dedup, mixing, ngrams, packing, tokens, toxicity
from tickloom.llm.common import materialize, numbered


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    # this application's own setting: whole texts reach Python in smaller record batches than narrow rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, scorer, 0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id (a null one is the smallest; then a
    content hash decides).  The older half of the id range is the snapshot, the rest the incoming batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2).cast("long"), F.lit(False))
    rows = numbered(docs, "numbered")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_content", "_row")
    keyed = rows.withColumn("_key", key)
    groups = dedup.dedup(keyed.where(~old), keyed.where(old), id_col="_key")
    return rows.join(groups.where("not kept").select("doc_id._row"), "_row", "left_anti").select(*docs.columns)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays (a null
    one is the largest; then a content hash decides).  Rows are documents of their own, whatever their ids:
    where one is null or occurs twice, they go by a row number, which takes one more copy of them."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        groups = ngrams.jaccard_components(docs, 5, 80)
        return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    rows = numbered(docs, "numbered")
    groups = ngrams.jaccard_components(rows, 5, 80, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_content", "_row")
    first = rows.select("_row", key.alias("_key")).join(groups, "_row").groupBy("component_id").agg(F.min("_key").alias("_key"))
    return rows.join(first.select("_key._row"), "_row", "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row appears once for each copy, whatever its id."""
    rows = numbered(docs, "numbered")
    mixed = mixing.mix(rows, [3, 1, 2], 1.5, 2.0, keys=("_content", "_row"))
    return mixing.emit(rows, mixed, "_row").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches by length bucket."""
    counts = tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(counts)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Scoring, components and dynamic programming are beyond SQL; tests/llm checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
