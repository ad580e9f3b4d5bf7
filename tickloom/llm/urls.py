"""URL rules behind a blocked Bloom filter, with DataFrame functions alone.

The filter is split-block: a key picks one 512-bit block by one hash and one bit in each of its
eight words by another.  It is aggregated with bit_or per block, so building it is one partial
aggregation; the finished filter is a table of blocks with a bound on its rows (``max_blocks``),
looked up by a broadcast hash join.  A listed key always passes.  False positives go to an exact
hash join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8


def _place(keys: list[Column], blocks: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"), F.xxhash64(F.lit("bits"), *keys)


def _mask(bits: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(n_keys: int, bits_per_key: int = 16, max_blocks: int = 16384) -> int:
    """Blocks (a power of two) for so many keys; never over max_blocks, 64 bytes each."""
    want, blocks = max(1, -(-n_keys * bits_per_key // 512)), 1
    while blocks < want and blocks < max_blocks:
        blocks *= 2
    return blocks


def build_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (b, w0 .. w7): one row for each block that holds a key, so at most ``blocks``
    rows.  Rows with a null key count like any other key."""
    block, bits = _place([F.col(c) for c in keys.columns], blocks)
    masks = keys.select(block.alias("b"), bits.alias("h")).select("b", *[_mask(F.col("h"), i).alias(f"w{i}") for i in range(WORDS)])
    return masks.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def in_bloom(rows: DataFrame, keys: list[Column], bloom: DataFrame, blocks: int) -> DataFrame:
    """Those rows whose key may have been added; a row whose key was added always passes.

    The filter's blocks are looked up by a broadcast hash join on the block number; ``blocks`` bounds
    what is broadcast, 72 bytes each.  rows are not shuffled."""
    block, bits = _place(keys, blocks)
    names = [unused(rows, f"_bloom{i}") for i in range(WORDS + 2)]
    words = F.broadcast(bloom.toDF(names[0], *names[2:]))
    hit = None
    for i in range(WORDS):
        m = _mask(F.col(names[1]), i)
        one = F.col(names[2 + i]).bitwiseAND(m) == m
        hit = one if hit is None else hit & one
    return rows.withColumns({names[0]: block, names[1]: bits}).join(words, names[0]).where(hit).select(*rows.columns)


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 16384) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    rules has host, path and verdict.  A rule fits its host and all subdomains of it when the
    path starts with the rule's; of those that fit, the one with the longest host and path wins
    (a tie on length: the longer host).  Where none fits, rule is null and verdict ``default``.

    Null urls and urls without ``://``: empty host and path, so no rule fits.  Repeated pages keep
    their rows.  An empty rule list gives the default everywhere.  Rules with a null host or path
    are ignored; of rules listed twice, block wins over allow.  Columns of pages named host,
    path, rule or verdict are replaced; others stay, whatever their names.

    Candidate keys of a url are (suffix of the host at a label, prefix of the path as long as some
    rule's path).  Those that the filter does not let through end there, so most never enter a join.
    """
    listed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n_rules, lengths = listed.agg(F.count("*"), F.collect_set(F.length("path"))).first()
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not n_rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = bloom_blocks(n_rules, max_blocks=max_blocks)
    bloom = build_bloom(listed.select("host", "path"), blocks)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in sorted(lengths)])
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(h.alias("h"), p.alias("p")))))
    keys = base.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(pairs).alias("k")).select("host", "path", F.col("k.h").alias("h"), F.col("k.p").alias("p"))
    passed = in_bloom(keys, [F.col("h"), F.col("p")], bloom, blocks)
    exact = passed.join(listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), "h", "p", "verdict")).alias("best"))
    found = unused(base, "_verdict")
    joined = base.join(best.select("host", "path", F.concat("best.h", "best.p").alias("rule"), F.col("best.verdict").alias(found)), ["host", "path"], "left")
    return joined.withColumn("verdict", F.coalesce(found, F.lit(default))).drop(found)
