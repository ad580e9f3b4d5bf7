"""One query for each operator over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, dedup, embeddings, mixing, ngrams, packing, sharding, tokens, toxicity, urls

RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of documents by their token counts."""
    counts = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(counts)


def op2_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as coded blocks; the result is decoded from those."""
    blocks = codec.write_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return codec.read_blocks(blocks)


def op3_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, 0.3)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 24)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(_table(spark, sf_dir, "documents"), 3, 90)


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {RULES}")
    return urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the id range is the immutable snapshot, the rest the incoming batch."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(None if low is None else (low + high) // 2).cast("long")
    is_old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return dedup.dedup(docs.where(~is_old), docs.where(is_old))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_length_buckets": op1_length_buckets,
        "op2_mixing_coder": op2_mixing_coder,
        "op3_fuzzy_toxicity": op3_fuzzy_toxicity,
        "op4_minimax_shards": op4_minimax_shards,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_systematic_mix": op6_systematic_mix,
        "op7_url_rules": op7_url_rules,
        "op8_grid_order_join": op8_grid_order_join,
        "op9_token_counts": op9_token_counts,
        "op10_fuse_dedup": op10_fuse_dedup,
    }
