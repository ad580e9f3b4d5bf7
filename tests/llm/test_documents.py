"""Operators over documents: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import itertools
import random
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import codec, dedup, mixing, ngrams, packing, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like the operators' own.
EXTRA = ("id", "digest", "size", "rank", "n", "rep", "gid", "keep", "bucket", "_rank", "_p", "n_tokens", "label")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def extra(*but):
    return {c: F.lit("x") for c in EXTRA if c not in but}


def text(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(words))


def rows():
    base = text(0, 120)
    near = base.split()
    near[60] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n"), (7, "one"), (8, "ONE"), (9, text(9, 30000)), (10, "a b"), (11, "é日本 🙂 <|endoftext|> x  y"), (12, "a b c"), (13, base.upper())]
    out += [(100 + i, base) for i in range(30)] + [(200 + i, text(200 + i, 40)) for i in range(30)]
    return [(i, t, "en", None if i == 7 else f"s{i % 3}", None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumns(extra()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns(extra())


# ---------------------------------------------------------------- exact dedup


def test_dedup_equals_brute_force(docs):
    got = dedup.dedup(docs.where("doc_id > 50"), docs.where("doc_id <= 50")).collect()
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in got} == want and len(got) == len(rows())


@pytest.mark.parametrize("old", ["false", "true", "doc_id % 2 = 0"])
def test_dedup_does_not_depend_on_the_split(docs, old):
    got = dedup.dedup(docs.where(f"not ({old})"), docs.where(old))
    assert got.where("kept").count() == len({t or "" for _, t, *_ in rows()})


def test_dedup_of_nothing(empty):
    assert dedup.dedup(empty, empty).count() == 0


def test_dedup_can_normalise(docs):
    got = dedup.dedup(docs.where("doc_id = 7"), docs.where("doc_id = 8"), F.lower("text")).orderBy("doc_id").collect()
    assert [r["keep_id"] for r in got] == [8, 8]


def test_dedup_of_null_and_repeated_ids(spark):
    data = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "b"), (6, None), (None, ""), (7, "c"), (7, "d")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for old in ("doc_id = 5", "doc_id is null", "text = 'b' and false"):
        was = F.coalesce(F.expr(old), F.lit(False))
        got = dedup.dedup(df.where(~was), df.where(was)).collect()
        kept = sorted((r["text_sha256"], r["doc_id"] or 0) for r in got if r["kept"])
        assert kept == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, i in [("a", 0), ("b", 5), ("", 6), ("c", 7), ("d", 7)])
        assert len(got) == len(data) and all(r["kept"] is not None for r in got)


def test_a_snapshot_serves_several_batches(spark, docs, tmp_path):
    old = docs.where("doc_id <= 50")
    made = dedup.write_snapshot(old, str(tmp_path / "s"))
    again = dedup.open_snapshot(spark, str(tmp_path / "s"))
    assert again.buckets == made.buckets and again.filters.count() == made.filters.count() > 0
    for batch in (docs.where("doc_id > 50"), docs.where("doc_id > 150")):
        got, want = dedup.dedup_against(batch, again, old), dedup.dedup(batch, old)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    (tmp_path / "half").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        dedup.open_snapshot(spark, str(tmp_path / "half"))


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_colliding_digests_are_told_apart_by_bytes(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "SCREEN_BLOCKS", most)
    monkeypatch.setattr(dedup, "_sha", lambda t: F.sha2(F.substring(t, 1, 1), 256))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "b"), (5, "ac"), (6, "ad")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in dedup.dedup(df.where("doc_id > 2"), df.where("doc_id <= 2")).collect()}
    assert got == {1: 3, 2: 5, 3: 3, 4: 4, 5: 5, 6: 6}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5000])
def test_fuse_filter_has_all_keys_and_few_others(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = dedup.build_fuse(np.r_[keys, keys])
    assert dedup.probe_fuse(keys, *f).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 20000).astype(np.uint64)
    assert dedup.probe_fuse(others, *f).mean() < 0.01


# ---------------------------------------------------------------- sharding


def least_capacity(sizes, shards):
    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        mid, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                n, used = n + 1, 0
            used += s
        low, high = (low, mid) if n <= shards else (mid, high)
    return high


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_minimax_and_contiguous(docs, shards):
    got = sharding.shard(docs, shards).toPandas()
    first, size = {}, {}
    for i, t, *_ in rows():
        first.setdefault(t or "", i)
        size[t or ""] = size.get(t or "", 0) + len((t or "").encode()) + 8
    order = sorted(first, key=first.get)
    assert got.groupby("shard")["size"].sum().max() == got["capacity"].iloc[0] == least_capacity([size[t] for t in order], shards)
    at = dict(zip(got["doc_id"], got["shard"], strict=True))
    assert all(at[i] == at[first[t or ""]] for i, t, *_ in rows())
    assert [at[first[t]] for t in order] == sorted(at[first[t]] for t in order) and 0 <= min(at.values()) <= max(at.values()) < shards
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_a_third_of_the_rows_leaves_no_shard_empty(spark):
    docs = spark.createDataFrame([(i, "same text " * 20 if i % 3 == 0 else text(i, 8 + i % 25), "en", "s", 0) for i in range(1500)], SCHEMA)
    sizes = sharding.shard(docs, 24).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"].sort_values().tolist()
    assert len(sizes) == 24 and sizes[-1] > 5 * sizes[0] and sizes[-2] < 1.06 * sizes[0]


@pytest.mark.parametrize("seed", range(4))
def test_cuts_have_the_largest_least_shard(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 9, 40]) for _ in range(14)]
    ends = np.cumsum([0, *sizes]).tolist()
    capacity = least_capacity(sizes, 4)
    best = 0
    for cuts in itertools.combinations(ends[1:-1], 3):
        parts = np.diff([0, *cuts, ends[-1]])
        if parts.max() <= capacity:
            best = max(best, parts.min())
    parts = np.diff([0, *sharding.even_cuts(ends, capacity, 4)])
    assert parts.min() == best and parts.max() <= capacity
    assert sharding.even_cuts([0, 5, 7], 5, 4) == [5, 7, 7, 7]


def test_search_refines_until_exact(spark, monkeypatch):
    r = random.Random(5)
    sizes = [r.randint(8, 400) for _ in range(900)] + [9000]
    before = np.cumsum([0, *sizes[:-1]]).tolist()
    df = spark.createDataFrame(list(zip(before, sizes, strict=True)), "before long, size long")
    capacity, cuts = sharding.minimax_cuts(df, sum(sizes), max(sizes), 24, cells=60)
    assert capacity == least_capacity(sizes, 24) and cuts[-1] == sum(sizes)


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 24).count() == 0


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(1)
    data = [(i, " ".join(["w"] * r.randint(0, 60)) if i % 50 else None, "en", ["big", "big", "mid", None][i % 4], 0) for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA).withColumns(extra())
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(5, "text")).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, g in got.groupby(got["source"].fillna("null")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 120 and g["target"].iloc[0] <= 2 * g["source_size"].iloc[0] + 1e-6
    total = got.drop_duplicates(["source"])
    assert total["target"].sum() == pytest.approx(min(1.5 * got["size"].sum(), 2 * got["size"].sum()))
    df = df.withColumns({c: F.lit("x") for c in ("_id", "_n", "_i", "copies")})
    emitted = mixing.emit(df, mixing.mix(df))
    assert emitted.columns == df.columns and emitted.count() == got["copies"].sum()


def test_targets_stop_at_the_cap(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(s, [3, 1, 2], 1.5, 2.0).collect()}
    assert got["a"] == 20 and got[None] == 180 and got["b"] == pytest.approx(1650 - 200)


def test_mix_of_nothing_and_of_empty_texts(spark, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", "x", "s", 0), (2, None, "x", "s", 0)], SCHEMA)).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0), (0, 0.0)]


def test_mix_emits_rows_with_null_and_repeated_ids(spark):
    ids = [None, None, 5, 5, 5, *range(10, 400)]
    docs = spark.createDataFrame([(i, text(k if k != 3 else 2, 5 + k % 9), "en", "ab"[k % 2], k if k != 3 else 2) for k, i in enumerate(ids)], SCHEMA)
    mixed = mixing.mix(docs, [3, 1, 2], 1.5, 2.0).toPandas()
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    got = got.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")).toPandas()
    assert len(got) == mixed["copies"].sum()
    for s, g in mixed.groupby("source"):
        assert got["size"][got["source"] == s].sum() == g["taken"].sum() and abs(g["taken"].sum() - g["target"].iloc[0]) <= 26
    assert (got["doc_id"] == 5).sum() == mixed["copies"][mixed["doc_id"] == 5].sum() > 0
    assert got["doc_id"].isna().sum() == mixed["copies"][mixed["doc_id"].isna()].sum() > 0


def test_exact_dedup_stage_keeps_one_row_of_a_text(spark):
    data = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "c"), (None, "c"), (None, "a"), (7, "d"), (7, "a"), (8, "e"), (8, "f"), (9, "e"), (0, None), (4, ""), (None, "g")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA).repartition(3)
    got = corpus_pipeline.exact_dedup_stage(spark, docs, "")
    want = [(7, "a"), (3, "b"), (None, "c"), (7, "d"), (9, "e"), (8, "f"), (4, ""), (None, "g")]
    assert got.columns == docs.columns and sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in got.collect())


# ---------------------------------------------------------------- token counts, packing


def test_counts_equal_the_library(docs):
    lib = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs, WORD, 2048).collect()}
    for i, t, *_ in rows():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


@pytest.mark.parametrize("t", ["aaaa aaaaaaaa aaa", "it's DON'T we'll", "<|startoftext|>a<|endoftext|>b <|x|>", "ΣΑΣ İ ß", "e\u0301 é", "a\x1cb\x85c\u3000d", "١２³½𝔸", "!!!...?'s'sx", "z" * 3000, "\u0301x", ""])
def test_odd_texts_count_as_the_library_does(t):
    assert tokens.counter(WORD).counts([t]) == [len(Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids)]


def test_counts_of_nothing(empty):
    assert tokens.token_counts(empty, WORD).count() == 0


def brute_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(values)) + 1):
        for cut in itertools.combinations(values[:-1], k - 1):
            edges = [*cut, values[-1]]
            pad = sum(next(e for e in edges if e >= x) - x for x in lengths)
            best = pad if best is None else min(best, pad)
    return best


@pytest.mark.parametrize("buckets", [1, 2, 4])
def test_boundaries_have_least_padding(spark, buckets):
    r = random.Random(buckets)
    lengths = [r.choice([0, 1, 3, 7, 8, 20, 21, 50, 90]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    got = packing.pack(df, buckets, budget=100).toPandas()
    assert got["padding"].sum() == brute_padding(lengths, buckets) and (got["padding"] >= 0).all()
    for (_, _), g in got.groupby(["bucket", "batch"]):
        assert len(g) * g["boundary"].iloc[0] <= 100 and sorted(g["slot"]) == list(range(len(g)))


def test_boundaries_fall_between_any_two_of_many_lengths(spark):
    # 5000 distinct lengths and one huge one: no common length may share a bucket's edge with its neighbours
    common = [(10, 4000), (11, 3000), (40, 2000)]
    lengths = [x for x, n in common for _ in range(n)] + list(range(1000, 6000)) + [10**7]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    got = packing.pack(df, 6).select("n_tokens", "padding").toPandas()

    values, count = np.unique(lengths, return_counts=True)
    rows, sums = np.cumsum(count), np.cumsum(count * values)
    best = values * rows - sums
    for _ in range(5):
        after = best.copy()
        for j in range(1, len(values)):
            after[j] = min(after[j], (best[:j] + values[j] * (rows[j] - rows[:j]) - (sums[j] - sums[:j])).min())
        best = after
    assert len(got) == len(lengths) and got["padding"].sum() == best[-1]


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5), (2, 10**6)], "doc_id long, n_tokens long")
    got = packing.pack(df, 3, budget=10).toPandas()
    assert len(got) == 4 and got["n_tokens"].tolist().count(0) == 1 and got["padding"].sum() == 0
    assert packing.pack(df.where("false")).count() == 0


# ---------------------------------------------------------------- coded blocks


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 1000, 70000])
def test_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    docs_, lens = [None, 5, 5], np.array([n // 3, 0, n - n // 3])
    block = codec.pack_block(docs_, lens, ids, 50257)
    names, lengths, back = codec.unpack_block(block)
    assert names == docs_ and lengths.tolist() == lens.tolist() and (back == ids).all()


def test_repeats_code_small_and_damage_is_found():
    ids = np.tile(np.arange(500, dtype=np.uint32), 200)
    block = codec.pack_block([1], np.array([len(ids)]), ids, 50257)
    assert len(block) < len(ids)
    for at in (3, 40, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            codec.unpack_block(bytes(bad))


def test_written_blocks_decode_to_the_library_ids(docs):
    lib = Tokenizer.from_file(BYTE)
    blocks = codec.write_blocks(docs, BYTE, 0, block_tokens=500)
    assert blocks.count() > 3
    got = {r["doc_id"]: r for r in codec.read_blocks(blocks).collect()}
    start = 0
    for i, t, *_ in sorted(rows()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in codec.read_ids(blocks).collect()}[10] == [*lib.encode("a b", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("t", ["a  b", "x \ny", " lead", "trail ", "a\n \nb", "a,\n\nb c.", "it's,\tb", "foo.\nBar, baz. Qux", "a!, b", "a,b. c", ".\n.", "\n", ", ", "a\x00, b"])
def test_encoder_equals_the_library(t):
    lib = Tokenizer.from_file(BYTE)
    assert np.frombuffer(codec.encoder(BYTE).encode(pa.array([t]))[0], "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_small_tables_are_not_cut_into_many_blocks(docs):
    """A file, and two child processes of the executor for it, were made for each range of ids."""
    few = codec.write_blocks(docs.where("doc_id < 300"), BYTE)
    assert few.count() == 1
    many = codec.write_blocks(docs, BYTE, block_tokens=20000)
    assert many.select("part").distinct().count() > 1
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(codec.read_blocks(few).select(key).collect()) == sorted(codec.read_blocks(many).select(key).collect())


def test_encoder_keeps_packed_pieces():
    """A worker's memory: pieces kept as objects took 116 bytes each here."""
    enc = codec.Encoder(BYTE)
    texts = pa.array([text(s, 10000) for s in range(6)])
    enc.encode(pa.array(["a b"]))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        enc.encode(texts)
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert len(enc.known) > 30000
    assert held < 60 * len(enc.known)


@pytest.mark.parametrize(("most", "size"), [(60, 1 << 20), (10**6, 300)])
def test_encoder_with_a_full_cache(monkeypatch, most, size):
    monkeypatch.setattr(codec.Encoder, "KEEP", most)
    monkeypatch.setattr(codec.Encoder, "KEEP_BYTES", size, raising=False)
    enc, lib = codec.Encoder(BYTE), Tokenizer.from_file(BYTE)
    for s in range(8):
        texts = ["", text(s, 40), "x " + text(s // 2, 30) + ".\nAé 日本", "", "one"]
        got = [np.frombuffer(r, "<u2").tolist() for r in enc.encode(pa.array(texts))]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) <= 160


def test_coded_words_are_fixed():
    """The format's words, as version 1 has them from the start."""
    i = np.arange(300_000, dtype=np.int64)
    ids = np.where(i % 3 == 0, i // 50 % 997, (i * i * 31 + i // 7) % 50257 >> (i % 11))
    lanes, steps, words, body = codec.encode_ids(ids, 50257)
    assert (lanes, steps, len(body)) == (2343, 129, 232083)
    assert zlib.crc32(words.astype("<u4").tobytes() + body.astype("<u2").tobytes()) == 1595426573
    assert (codec.decode_ids(len(ids), 50257, lanes, steps, words, body) == ids).all()


def test_blocks_of_nothing(empty):
    assert codec.read_blocks(codec.write_blocks(empty, BYTE)).count() == 0


# ---------------------------------------------------------------- n-gram join


def brute_components(data, n, percent):
    sets = []
    for _, t, *_ in data:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: data[k][0])] = min(a, b, key=lambda k: data[k][0])
    return {(data[i][0], len(sets[i]), data[find(i)][0]) for i in range(len(data))}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs, n, percent):
    got = ngrams.jaccard_components(docs, n, percent).collect()
    assert {tuple(r) for r in got} == brute_components(rows(), n, percent) and len(got) == len(rows())


def test_components_of_a_chain_of_edits(spark, monkeypatch):
    """Documents that share a frequent passage, and a chain in which only neighbours are similar."""
    monkeypatch.setattr(ngrams, "HEAVY_FROM", 3)
    passage, data = text(1, 30), []
    words = text(2, 100).split()
    for i in range(25):
        data.append((i, " ".join(words), "en", "s", 0))
        words[(i * 4) % 100] = f"edit{i}"
    data += [(100 + i, passage + " " + text(500 + i, 40), "en", "s", 0) for i in range(25)]
    data += [(200 + i, passage + " " + text(900 + i, 2), "en", "s", 0) for i in range(25)]
    got = ngrams.jaccard_components(spark.createDataFrame(data, SCHEMA), 3, 90).collect()
    assert {tuple(r) for r in got} == brute_components(data, 3, 90)


def test_rows_of_one_id_lose_no_link(spark):
    a, b = text(70, 60), text(71, 60)
    c = text(72, 60)
    data = [(5, a), (5, b), (9, b + " more"), (10, a + " more"), (None, c), (20, c), (None, "odd one"), (21, None), (21, ""), (30, a.upper()), (5, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngrams.jaccard_components(docs, 3, 90).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (5, 5), (9, 5), (10, 5), (30, 5), (None, 20), (20, 20), (None, None), (21, 21), (21, 21)], key=str)


def test_more_text_is_counted_in_more_ranges(docs, monkeypatch):
    few = ngrams._ranges(docs)
    monkeypatch.setattr(ngrams, "RANGE_BYTES", 100)
    assert ngrams._ranges(docs) > few == 256


def test_components_of_nothing(empty):
    assert ngrams.jaccard_components(empty, 5, 80).count() == 0


# ---------------------------------------------------------------- toxicity


def brute_distance(a, b):
    """Edits by one letter and swaps of neighbours, each letter edited once at most."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms, stems = ["idiot", "moron", "scum", "stupid"], ["lowei", "vile"]
    lex = toxicity.FuzzyLexicon(terms, stems)
    r = random.Random(0)
    words = terms + ["idi0t", "idiott", "iddiot", "diot", "xidiot", "scam", "scums", "loweixyz", "lowe", "lowie", "loewixyz", "viles", "vlie", "stupidly", "stuipd", "idito", "diiot", "iidot", ""]
    for t in (terms + stems) * 60:
        w = list(t + r.choice(["", "", "xy"]))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            if r.random() < 0.4 and k > 1:
                w[k - 2 : k] = w[k - 2 : k][::-1]
            else:
                w[k : k + r.randint(0, 1)] = r.choice(["", "a", "i", "z"])
        words.append("".join(w))

    def near(w, t):
        return len(t) >= toxicity.LEAST_FUZZY and w[:1] == t[0] and brute_distance(w[1:], t[1:]) <= 1

    found = set()
    for w in words:
        if w in terms:
            want = toxicity.EXACT
        elif any(w.startswith(s) for s in stems):
            want = toxicity.STEM
        elif any(near(w, t) for t in terms):
            want = toxicity.FUZZY
        else:
            want = toxicity.FUZZY_STEM if any(near(w[:k], s) for s in stems for k in range(len(w) + 1)) else 0
        assert lex.match(w) == want, w
        found.add(want)
    assert len(found) == 5


def labelled(spark, n=900):
    r, data, marks = random.Random(4), [], []
    for i in range(n):
        bad = r.random() < 0.2
        words = text(i, 60).split()
        if bad:
            for k in r.sample(range(60), 5):
                words[k] = r.choice(["blorgon", "snarfle", "zemitu" + r.choice("abcdef") * 2])
        data.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(data, SCHEMA).withColumns(extra()), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_scores_find_toxic_texts_that_were_held_out(spark):
    docs_, labels = labelled(spark)
    scorer = toxicity.train(docs_, labels)
    assert {"blorgon", "snarfle"} <= set(scorer.lexicon.terms) and scorer.lexicon.stems
    got = toxicity.score(docs_, scorer).withColumn("held", toxicity.held_out()).join(labels, "doc_id").where("held").collect()
    assert len(got) > 150 and all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in got)
    clean = toxicity.reject(docs_, scorer)
    assert clean.columns == docs_.columns and clean.count() == toxicity.score(docs_, scorer).where("predicted = 0").count()


def test_labels_held_out_are_not_learned_from(spark):
    docs_, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs_, labels), toxicity.train(docs_, flipped)
    assert a.lexicon.terms == b.lexicon.terms and np.allclose(a.weights, b.weights)


def test_densest_window_may_stand_anywhere():
    scorer = toxicity.Scorer(toxicity.FuzzyLexicon(["vilest"], []))
    far = " ".join(["vilest " + "x " * 20] * 300) + " vilest" * 7
    assert scorer.all_features([far])[0][6] == pytest.approx(np.log1p(7))


def test_misspelt_texts_are_found_by_the_automaton_and_quoted_ones_are_left():
    """Held-out texts in which each term is misspelt decide recall, and twins with all terms in quotation marks
    decide precision; without edits the same lexicon finds none of the first."""
    r, texts, marks = random.Random(8), [], []
    for i in range(1200):
        bad = i % 5 == 0
        words = text(i, 50).split()
        for k in r.sample(range(50), 4) if bad else []:
            words[k] = r.choice(["blorgon", "snarfle", "zemitup", "wurblik"])
        texts.append(" ".join(words))
        marks.append(int(bad))
    scorer = toxicity.fit(texts[:800], marks[:800], [])
    terms = scorer.lexicon.terms
    assert set(terms) == {"blorgon", "snarfle", "zemitup", "wurblik"}
    toxic = [t for t, y in zip(texts[800:], marks[800:], strict=True) if y]
    clean = [t for t, y in zip(texts[800:], marks[800:], strict=True) if not y]
    wrong = [" ".join(w[:3] + w[4] + w[3] + w[5:] if w in terms else w for w in t.split()) for t in toxic]
    quoted = [" ".join(f'"{w}"' if w in terms else w for w in t.split()) for t in toxic]
    assert (scorer.scores(toxic) >= 0.3).all() and (scorer.scores(clean) < 0.3).all()
    assert (scorer.scores(wrong) >= 0.3).mean() > 0.95 and (scorer.scores(quoted) < 0.3).all()
    plain = toxicity.Scorer(toxicity.FuzzyLexicon(terms, scorer.lexicon.stems, edits=0), scorer.weights)
    assert (plain.scores(toxic) >= 0.3).all() and (plain.scores(wrong) < 0.3).all()


def test_weights_keep_their_signs():
    r = np.random.default_rng(0)
    x = np.c_[np.ones(400), r.random((400, 8))]
    y = (x[:, 5] - x[:, 2] + 0.3 * r.normal(size=400) > 0).astype(float)  # an edit would lower the score, a quotation raise it
    w = toxicity.fit_weights(x, y)
    assert (w >= toxicity.LEAST).all() and (w <= toxicity.GREATEST).all() and w[2] == 0 and w[5] == 0


def test_misspellings_count_and_quotations_do_not():
    s = toxicity.Scorer(toxicity.FuzzyLexicon(["blorgon"], []), toxicity.PRIOR)
    plain, quoted, misspelt, clean = s.scores(["you blorgon", 'they said "you blorgon" to me', "you blorgan", "you are"])
    assert plain > misspelt > clean and plain > quoted


def test_scores_of_odd_texts_and_without_labels(spark, docs, empty):
    scorer = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, scorer).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, nulls)).count() == len(rows())
