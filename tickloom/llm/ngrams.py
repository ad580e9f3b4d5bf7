"""Jaccard self-join on word shingles: grouped prefix join.

1. Frequencies.  Each task packs its shingle hashes by hash range; one reducer for each range counts
   them, so no row is made for a shingle.  The most frequent ones (at most MOST_HEAVY, the bound
   of what is broadcast) come last in the global order, by frequency; all others by hash.  Any
   order gives the same result; this one keeps passages and lines that many documents share out
   of the prefixes.
2. Prefixes.  A document's prefix in that order must share at least 3 tokens (fewer for small sets)
   with that of any document similar enough.  Equal sets collapse to one representative, and
   representatives with equal prefix and size to one group.
3. Hubs.  In each posting list, members are verified against one group only, the one in whose prefix
   the token comes first: of near copies, that with the fewest rare tokens of its own.  Most of a
   cluster meets in one component, with as many pairs as members.
4. Group pairs.  What is left are pairs from different components: posting lists are collapsed to
   (group, component), paired, filtered by size, shared tokens and position, then expanded to
   members and verified.  Pairs that step 3 has joined anyway are never made.

Only connected components and set sizes are asked for, so leaving out pairs inside a component
loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_groups, materialize, partitions, sole_cache, text_batches, trim
from .tokens import batches

HEAVY_FROM = 16
MOST_HEAVY = 1 << 20
SHARED = 3
BROADCAST_IDS = 1 << 21
#: Bytes of input for each hash range of the shingle counts.
RANGE_BYTES = 1 << 24
U = np.uint64


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


_WORDS = _Words()


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    sole_cache("word hashes", _WORDS.clear)
    return [shingle_set(t, n) for t in texts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; A-Z lower-cased, words are runs of other
    than ASCII white space.  With fewer words the whole sequence is one shingle; without, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    a = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, U)
    for i in range(k):
        h = (h + a[i : len(a) - k + 1 + i]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
    return np.unique(_mixed(h))


def _need(size: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of this size with any similar one: ceil(num * size / den)."""
    return -(-num * size // den)


# ---------------------------------------------------------------- 1. frequencies


def heavy_tokens(docs: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Top 40 bits of the hashes of frequent shingles, in ascending order of frequency."""
    shift = U(24)

    def pack(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(table, "text"):
            sets = _sets(b.column(1).to_pylist(), n)
            keys, counts = np.unique(np.concatenate([np.zeros(0, U), *sets]) >> shift, return_counts=True)
            part = (keys * U(buckets)) >> U(40)
            cuts = np.searchsorted(part, np.arange(buckets + 1, dtype=U))
            rows = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
            width = U(-(-(1 << 40) // buckets))  # offsets within a range fit 32 bits from 256 ranges on
            local = (keys - (U(0) + (part * U(1 << 40) + U(buckets - 1)) // U(buckets))).astype(np.uint32)
            assert width <= U(1 << 32)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([local[cuts[k] : cuts[k + 1]].tobytes() for k in rows], pa.binary()), pa.array([counts[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes() for k in rows], pa.binary())], ["bucket", "keys", "counts"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(times.astype(np.int64), starts)
        keep = total >= HEAVY_FROM
        first = (int(pdf["bucket"].iloc[0]) * (1 << 40) + buckets - 1) // buckets
        return pd.DataFrame({"token": keys[starts][keep].astype(np.int64) + first, "n": total[keep]})

    packed = docs.select("id", "text").mapInArrow(pack, "bucket int, keys binary, counts binary")
    found = packed.groupBy("bucket").applyInPandas(count, "token long, n long")
    top = found.orderBy(F.desc("n"), "token").limit(MOST_HEAVY).toArrow()
    tokens, times = top.column(0).to_numpy().astype(U), top.column(1).to_numpy()
    return tokens[np.lexsort((tokens, times))]


# ---------------------------------------------------------------- 2. prefixes


class _Order:
    """The global order of tokens."""

    def __init__(self, heavy: np.ndarray):
        by = np.argsort(heavy)
        self.keys, self.rank = heavy[by], by
        self.screen = np.zeros(1 << 22, dtype=bool)
        self.screen[(heavy & U((1 << 22) - 1)).astype(np.int64)] = True

    def first(self, tokens: np.ndarray, k: int) -> np.ndarray:
        """The first k of sorted tokens."""
        if not len(self.keys):
            return tokens[:k]
        key = tokens >> U(24)
        maybe = np.flatnonzero(self.screen[(key & U((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        real = self.keys[at] == key[maybe]
        maybe, rank = maybe[real], self.rank[at[real]]
        light = np.delete(tokens, maybe)
        if len(light) >= k:
            return light[:k]
        late = tokens[maybe][np.lexsort((tokens[maybe], rank))]
        return np.r_[light, late[: k - len(light)]]


def _marks(s: np.ndarray) -> tuple[int, int, int]:
    """Size of a set and a signature of 128 bits, which does not depend on order."""
    return len(s), int(s.sum().astype(np.int64)), int(_mixed(s ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64))


def signatures(docs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    """(id, n, s1, s2, p, prefix): set size, signature of the set, of the prefix, and the prefix."""

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for b in batches(table, "text"):
            marks, sp, prefixes = [], [], []
            for s in _sets(b.column(1).to_pylist(), n):
                need = _need(len(s), num, den)
                pre = o.first(s, len(s) - need + min(SHARED, need)) if len(s) else s
                marks.append(_marks(s))
                sp.append(int(_mixed(pre + U(0x14057B7EF767814F)).sum().astype(np.int64)))
                prefixes.append(pre.astype(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(3)], pa.array(sp, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "n", "s1", "s2", "p", "prefix"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, s1 long, s2 long, p long, prefix array<long>")


# ---------------------------------------------------------------- verification


def _verified(docs: DataFrame, equal: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets are similar.  Sets are made again for the nodes in pairs
    only, from the text whose id and signature are the node's."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = materialize(equal.join(ends, "node").select("id", "node", "n", "s1", "s2"), "needed")
    few = needed.count() <= BROADCAST_IDS
    texts = docs.select("id", "text").join(F.broadcast(needed) if few else needed, "id").select("node", "text", "n", "s1", "s2")

    def make(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(table, "text"):
            found = _sets(b.column(1).to_pylist(), n)
            mine = [k for k, (s, *m) in enumerate(zip(found, *[b.column(c).to_pylist() for c in (2, 3, 4)], strict=True)) if _marks(s) == tuple(m)]
            sets = [np.unique(found[k] >> U(16)) for k in mine]
            blob = [(s >> U(32)).astype("<u2").tobytes() + (s & U(0xFFFFFFFF)).astype("<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine, pa.int64())), pa.array(blob, pa.binary())], ["node", "set"])

    sets = materialize(texts.mapInArrow(make, "node long, set binary"), "sets")

    def load(x: bytes) -> np.ndarray:
        m = len(x) // 6
        return (np.frombuffer(x, "<u2", m).astype(np.int64) << 32) | np.frombuffer(x, "<u4", m, 2 * m)

    def compare(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            a_id, b_id = b.column(0).to_pylist(), b.column(1).to_pylist()
            held, name, keep = np.zeros(0, np.int64), None, []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                if a_id[k] != name:
                    name, held = a_id[k], load(x.as_py())
                other = load(y.as_py())
                both = len(np.intersect1d(held, other, assume_unique=True))
                if den * both >= num * (len(held) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a_id[k] for k in keep], pa.int64()), pa.array([b_id[k] for k in keep], pa.int64())], ["u", "v"])

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    links = materialize(two.select("a", "b", "set_a", "set_b").mapInArrow(compare, "u long, v long"), "links")
    discard(needed, sets)
    return links


def _alike(x: Column, y: Column, num: int, den: int) -> Column:
    return den * F.least(x, y) >= num * F.greatest(x, y)


def _enough(x: Column, num: int, den: int) -> Column:
    return F.least(F.lit(SHARED), F.ceil(x * num / den))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: documents are linked when
    100 * intersection >= percent * union of their distinct n-word shingles.

    component_id is the smallest id reachable.  Texts without words, and null ones, have no shingles
    and stay alone.  A row with a null id is kept; it takes the component of an equal set, else null.  Rows
    with a repeated id are one document with several sets, all of which link it; n_shingles is the row's
    own.  Empty tables give no rows.  Only the two columns are read.

    Any set, prefix or shingle may belong to a third of all rows: what is joined back to many rows is
    broadcast where it is that frequent (join_groups).
    """
    with text_batches(docs.sparkSession):
        return _components(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, percent, 100)


def _ranges(docs: DataFrame) -> int:
    """How many hash ranges count the shingles: more of them the more text there is.  The plan knows the
    size of files; where it does not, texts are measured."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(1 << 20, max(256, 4 * partitions(docs.sparkSession), size // RANGE_BYTES))


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_Order(heavy_tokens(docs, n, _ranges(docs))))
    sigs = materialize(signatures(docs, n, num, den, order).withColumn("sig", F.struct("n", "s1", "s2")), "signatures")
    order.destroy()
    trim()
    slim = sigs.where("n > 0 and id is not null").select("id", "sig", "p")

    # a node is a set of shingles; its number is fixed by writing it
    equal = slim.groupBy("sig").agg(F.min("id").alias("id"), F.min("p").alias("p"), F.count("*").alias("copies"))
    equal = materialize(equal.select(F.monotonically_increasing_id().alias("node"), "sig", "sig.*", "id", "copies", F.struct("p", "sig.n").alias("key")), "equal")
    n_sets, n_rows = (x or 0 for x in equal.agg(F.count("*"), F.sum("copies")).first())
    groups = materialize(equal.groupBy("key").agg(F.min("node").alias("gid"), F.count("*").alias("m")), "groups")
    members = materialize(join_groups(equal.select("node", "key", "n"), groups, "key", "m", n_sets).select("node", "gid", "n", "m"), "members")

    heads = members.where("node = gid").select("gid", "m").join(equal.select(F.col("node").alias("gid"), "id", "sig"), "gid")
    prefixes = materialize(sigs.select("id", "sig", "n", "prefix").join(heads, ["id", "sig"]).dropDuplicates(["gid"]).select("gid", "n", "m", "prefix"), "prefixes")
    index = prefixes.select("gid", "n", "m", F.posexplode("prefix").alias("pos", "token"))
    lists = index.groupBy("token").agg(F.sum("m").alias("k"), F.count("*").alias("times"), F.min(F.struct("pos", "gid", "n")).alias("hub")).where("k > 1")
    lists = materialize(lists.select("token", "times", "hub"), "lists")
    n_posts = lists.agg(F.sum("times")).first()[0] or 0
    posts = materialize(join_groups(index, lists, "token", "times", n_posts).drop("times"), "posts")

    # 3. everyone against one group of each list
    hubs = posts.where("gid <> hub.gid or m > 1").groupBy("gid", "n", F.col("hub.gid").alias("hub"), F.col("hub.n").alias("hub_n")).agg(F.count("*").alias("shared"))
    hubs = hubs.where(_alike(F.col("n"), F.col("hub_n"), num, den) & (F.col("shared") >= F.least(_enough(F.col("n"), num, den), _enough(F.col("hub_n"), num, den))))
    pairs = hubs.join(members.select("node", "gid"), "gid").where("node <> hub").select(F.greatest("hub", "node").alias("a"), F.least("hub", "node").alias("b")).distinct()
    pairs = materialize(pairs, "hubs")
    links = _verified(docs, equal, pairs, n, num, den)
    discard(lists, pairs)
    label = components(links)

    # 4. pairs of groups in different components
    of = materialize(members.join(label, "node", "left").select("node", "gid", "n", F.coalesce("component", "node").alias("comp")), "of")
    kinds = of.select("gid", "comp").distinct()
    entity = posts.select("token", "gid", "n", "pos").join(kinds, "gid")
    mixed = entity.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    entity = materialize(entity.join(mixed, "token"), "entities")
    discard(posts, members, groups)
    # the first token that a similar pair shares leaves room for the overlap in both sets
    room = lambda reach, x, y: (num + den) * F.col(reach) >= num * (F.col(x) + F.col(y))
    spans = entity.groupBy("token", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"))
    left, right = (spans.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "low", "high", "reach")]) for s in "ab")
    sizes = (den * F.col("high_b") >= num * F.col("low_a")) & (den * F.col("high_a") >= num * F.col("low_b"))
    apart = left.join(right, "token").where((F.col("comp_a") < F.col("comp_b")) & sizes & room("reach_a", "low_a", "low_b") & room("reach_b", "low_a", "low_b")).select("token", "comp_a", "comp_b")
    ea, eb = (entity.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "gid", "n")], (F.col("n") - F.col("pos")).alias(f"reach_{s}")) for s in "ab")
    met = apart.join(ea, ["token", "comp_a"]).join(eb, ["token", "comp_b"]).where(_alike(F.col("n_a"), F.col("n_b"), num, den) & room("reach_a", "n_a", "n_b") & room("reach_b", "n_a", "n_b"))
    met = met.select("gid_a", "n_a", "comp_a", "gid_b", "n_b", "comp_b").distinct()
    pa_, pb = (prefixes.select(F.col("gid").alias(f"gid_{s}"), F.col("prefix").alias(f"prefix_{s}")) for s in "ab")
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    found = met.join(pa_, "gid_a").join(pb, "gid_b").where(shared >= F.least(_enough(F.col("n_a"), num, den), _enough(F.col("n_b"), num, den)))
    ra, rb = (of.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("gid", "comp")]) for s in "ab")
    pairs = found.join(ra, ["gid_a", "comp_a"]).join(rb, ["gid_b", "comp_b"]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    discard(entity, prefixes)
    more = _verified(docs, equal, pairs, n, num, den)
    discard(pairs, of)

    # sets of one id belong together
    sets = slim.groupBy("id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("id")
    several = slim.join(F.broadcast(sets) if sets.count() <= BROADCAST_IDS else sets, "id", "left_semi").select("id", "sig").distinct().join(equal.select("sig", "node"), "sig")
    same = several.join(several.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v")
    label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more).union(same))

    # a component's number is its smallest id
    placed = materialize(equal.join(label, "node", "left").select("sig", "id", "copies", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("sets"))
    named = materialize(join_groups(placed, least, "component", "sets", n_sets).select("sig", "copies", "component_id"), "named")
    discard(placed, links, more, equal)
    alone = sigs.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    rows = sigs.where("n > 0").select("id", "n", "sig")
    unknown = rows.where("id is null").join(named.select("sig", "component_id"), "sig", "left").select("id", "n", "component_id")
    linked = join_groups(rows.where("id is not null"), named, "sig", "copies", n_rows).select("id", "n", "component_id")
    out = alone.union(unknown).union(linked)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
