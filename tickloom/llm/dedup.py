"""Exact deduplication of a batch against an immutable snapshot.

A snapshot is a folder: its rows' digests, its groups of equal digests, one static binary-fuse
filter for each bucket of groups, and a manifest that is written last.  It is made once and never
changed, so batch after batch is screened by the same filters.  Incoming digests are grouped first
(new-batch duplicates meet there), screened by their bucket's filter, and only positives join
the exact buckets.  Texts with a common digest are then compared byte for byte.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, partitions, shared_dir
from .urls import bloom_blocks, build_bloom, in_bloom

KEYS_PER_FILTER = 1 << 16
#: Blocks of the screen for the byte check: 19 MB to broadcast, for 8 million digests.
SCREEN_BLOCKS = 1 << 18
_M = np.uint64(0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * _M
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _spots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments for each key, and its fingerprint."""
    h = _mix(keys, seed)
    start = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
    low = h & np.uint64(0xFFFFFFFFFF)
    mask = np.uint64(segment - 1)
    at = np.stack([(start + np.uint64(i)) * np.uint64(segment) + ((low >> np.uint64(13 * i)) & mask) for i in range(3)]).astype(np.int64)
    return at, (_mix(h, 7) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a static filter over uint64 keys.

    Peeling goes in waves: all slots with one key left give up that key at once; keys are assigned
    in the reverse order of waves.  A seed that leaves a core is replaced by the next one.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    segment = 16
    while segment * 24 < n and segment < 8192:
        segment *= 2
    segments = max(1, -(-int(n * 1.35 + 32) // segment) - 2)
    for seed in range(1, 200):
        at, mark = _spots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, dtype=np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        alive, waves = np.ones(n, dtype=bool), []
        while True:
            slots = np.flatnonzero(count == 1)
            found, first = np.unique(who[slots], return_index=True)
            if not len(found):
                break
            waves.append((found, slots[first]))
            alive[found] = False
            for row in at:
                np.subtract.at(count, row[found], 1)
                np.bitwise_xor.at(who, row[found], found)
        if not alive.any():
            prints = np.zeros(size, dtype=np.uint8)
            for found, slot in reversed(waves):
                prints[slot] = 0
                prints[slot] = mark[found] ^ prints[at[0][found]] ^ prints[at[1][found]] ^ prints[at[2][found]]
            return seed, segment, segments, prints.tobytes()
        segments += max(1, segments // 8)
    raise RuntimeError("no seed peels this filter")


def probe_fuse(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """True for every key in the filter and for about one in 256 others."""
    at, mark = _spots(np.asarray(keys, dtype=np.uint64), seed, segment, segments)
    p = np.frombuffer(prints, dtype=np.uint8)
    return p[at[0]] ^ p[at[1]] ^ p[at[2]] == mark


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests], dtype=np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, prints = build_fuse(_keys(pdf["digest"]))
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": [seed], "segment": [segment], "segments": [segments], "prints": [prints]})


def _screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return left[["digest"]].iloc[:0]
    f = right.iloc[0]
    return left.loc[probe_fuse(_keys(left["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["prints"]), ["digest"]]


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.conv(F.substring("digest", 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))


def snapshot_filters(groups: DataFrame) -> DataFrame:
    """One filter row per bucket of a snapshot's distinct digests, which have their bucket."""
    return groups.select("digest", "bucket").groupBy("bucket").applyInPandas(_build, "bucket int, seed int, segment int, segments int, prints binary")


def _text(normal: Column | None, text_col: str) -> Column:
    return F.coalesce(normal if normal is not None else F.col(text_col), F.lit(""))


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _key(text: Column, colliding: list[str]) -> Column:
    """The digest of a text; with the text itself behind it where texts are known to collide."""
    return F.when(_sha(text).isin(colliding), F.concat(_sha(text), text)).otherwise(_sha(text)) if colliding else _sha(text)


def _digests(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, row, digest): row tells rows of equal id apart once the table is written."""
    return df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), key.alias("digest"))


def _grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep, n): the row that stays is the largest (id, row); a null id is the smallest."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Snapshot:
    """A finished snapshot: its tables, read from its folder."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int
    n_rows: int


def write_snapshot(docs: DataFrame, path: str, normal: Column | None = None, id_col: str = "doc_id", text_col: str = "text", colliding: list[str] = ()) -> Snapshot:
    """Writes the snapshot of docs to a new folder.  The manifest comes last: a folder without one is
    no snapshot, so a writer that was lost leaves nothing that could be taken for one."""
    spark = docs.sparkSession
    _digests(docs, _key(_text(normal, text_col), colliding), id_col).write.parquet(f"{path}/rows")
    grouped = materialize(_grouped(spark.read.parquet(f"{path}/rows")), "grouped")
    n_rows, n_groups = (x or 0 for x in grouped.agg(F.sum("n"), F.count("*")).first())
    buckets = max(1, min(partitions(spark), n_groups), -(-n_groups // KEYS_PER_FILTER))
    bucketed(grouped, buckets).write.parquet(f"{path}/groups")
    snapshot_filters(spark.read.parquet(f"{path}/groups")).write.parquet(f"{path}/filters")
    spark.range(1).select(F.lit(1).alias("version"), F.lit(buckets).alias("buckets"), F.lit(n_rows).cast("long").alias("n_rows")).write.parquet(f"{path}/manifest")
    return open_snapshot(spark, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    m = spark.read.parquet(f"{path}/manifest").first()
    if m["version"] != 1:
        raise ValueError(f"{path} is not a snapshot of this version")
    rows, groups, filters = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "groups", "filters"))
    return Snapshot(rows, groups, filters, m["buckets"], m["n_rows"])


def dedup(batch: DataFrame, snapshot: DataFrame, normal: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of batch and snapshot.

    Texts are equal when identical after ``normal`` (no change by default).  Null counts as the
    empty text.  Of equal texts the row with the largest id stays, wherever it is; a null id is
    smaller than any.  Of rows with equal texts and that same id one stays and the others go, so
    exactly one row of a group has ``kept``, which is never null; keep_id is null only where all ids of
    a group are.  Empty tables give no rows.  Other columns are not read.  If two texts share a
    SHA-256, the byte check puts them in groups of their own.
    """
    spark = batch.sparkSession
    made = write_snapshot(snapshot, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}", normal, id_col, text_col)
    return dedup_against(batch, made, snapshot, normal, id_col, text_col)


def dedup_against(batch: DataFrame, made: Snapshot, snapshot: DataFrame, normal: Column | None = None, id_col: str = "doc_id", text_col: str = "text", colliding: list[str] = ()) -> DataFrame:
    """dedup() of a batch with the finished snapshot of a table; the table itself is read only for
    the byte check.

    Any group may hold a third of all rows: groups are partial aggregates, the few large ones are
    broadcast back to their rows, and for the byte check every task sends a text once."""
    spark = batch.sparkSession
    text = _text(normal, text_col)
    # rows of the batch are numbered apart from those of the snapshot
    incoming = materialize(_digests(batch, _key(text, colliding), id_col).withColumn("row", -1 - F.col("row")), "digests")
    new = materialize(_grouped(incoming), "incoming")
    buckets = made.buckets
    screened = bucketed(new.select("digest"), buckets).groupBy("bucket").cogroup(made.filters.groupBy("bucket")).applyInPandas(_screen, "digest string")
    old = made.groups.select("digest", "keep", "n")
    met = materialize(screened.join(old.withColumnsRenamed({"keep": "k0", "n": "n0"}), "digest"), "met")
    new_groups = new.join(met, "digest", "left").select("digest", F.greatest("keep", "k0").alias("keep"), (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"))
    groups = materialize(new_groups.union(old.join(met, "digest", "left_anti")), "groups")
    both = incoming.union(made.rows.select(*incoming.columns))
    total = made.n_rows + (new.agg(F.sum("n")).first()[0] or 0)

    shared = groups.where("n > 1").select("digest")
    texts = batch.select(text.alias("text")).union(snapshot.select(text.alias("text"))).select(_key(F.col("text"), colliding).alias("digest"), "text")
    odd = differing(texts, shared, shared.count())
    if odd:
        again = [*colliding, *odd]
        apart = write_snapshot(snapshot, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}", normal, id_col, text_col, again)
        return dedup_against(batch, apart, snapshot, normal, id_col, text_col, again)
    joined = join_groups(both, groups, "digest", "n", total)
    return joined.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.substring("digest", 1, 64).alias("text_sha256"))


def differing(texts: DataFrame, shared: DataFrame, n_shared: int) -> list[str]:
    """The byte check: those digests with several texts, of (digest, text) rows.  None is to be expected.

    A blocked Bloom filter over the digests that occur twice is applied in the scan, so other texts
    are never shuffled.  Its size is checked: above SCREEN_BLOCKS there is no screen, and every
    distinct text of a task is sent once.  Equal texts of a task meet before the exchange, so a
    text that a third of all rows share is sent once by each task."""
    blocks = bloom_blocks(n_shared, max_blocks=1 << 40)
    if not n_shared:
        return []
    some = in_bloom(texts, [F.col("digest")], build_bloom(shared, blocks), blocks) if blocks <= SCREEN_BLOCKS else texts
    kinds = some.distinct().groupBy("digest").agg(F.count("*").alias("n"))
    return [r["digest"] for r in kinds.where("n > 1").select("digest").collect()]
