"""URL rules, embeddings, components, ranks, and the registered queries."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, embeddings, urls

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, of_duckdb, of_spark, views  # noqa: E402

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules_equal_brute_force(spark):
    r = random.Random(0)
    found = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://x.com?q", "http://A.B", "http://x.a.b?y=1", "http://.com/", "http://com.evil/en/", "http://notexample.com/en/", "http://ÀB.com/x#y", "a://b://c.net/es/1"]
    hosts = ["example.com", "www.example.com", "m.www.example.com", "x.net", "net", "org", "a.b", "EXAMPLE.COM"]
    found += [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en', '/en/', '/en/x', '/es/', '/EN/'])}{r.choice(['', '?a/b', '#c'])}" for _ in range(300)]
    df = spark.createDataFrame([(i % 50, u, "other") for i, u in enumerate(found)], "page_id long, url string, html string").withColumns({"keys": F.lit(1), "h": F.lit(2), "k": F.lit(3), "rule": F.lit("old"), "_v": F.lit(4), "_verdict": F.lit(5)})
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    got = sorted((r["url"] or "", r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urls.judge_urls(df, rules).collect())
    assert got == sorted((u or "", *[x or "" for x in brute(u)]) for u in found)
    assert {"_v", "_verdict"} <= set(urls.judge_urls(df, rules).columns)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    page = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urls.judge_urls(page, none).first()["verdict"] == "allow"
    assert urls.judge_urls(page.where("false"), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_filter_passes_all_listed_keys(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = urls.bloom_blocks(n)
    bloom = urls.build_bloom(keys, blocks)
    assert bloom.count() <= blocks and urls.in_bloom(keys, [F.col("k")], bloom, blocks).count() == n
    other = spark.range(10000).select(F.concat(F.lit("z"), "id").alias("k"), F.lit(1).alias("_bloom0"))
    some = urls.in_bloom(other, [F.col("k")], bloom, blocks)
    assert some.columns == other.columns and some.count() < 200


def test_filter_size_is_bounded():
    assert urls.bloom_blocks(10**12) == 16384


# ---------------------------------------------------------------- embeddings


def vectors():
    rng = np.random.default_rng(0)
    out = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    for c in range(6):
        centre = rng.normal(size=16)
        out += [(1000 + 50 * c + k, (centre + rng.normal(size=16) * 0.05 * (k % 5)).tolist()) for k in range(40)]
    same = rng.normal(size=16).tolist()
    out += [(2000 + k, same) for k in range(60)] + [(2100, [2 * x for x in same])]
    out += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [float("nan")] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 0.0]), (3007, [2.0, 0.0]), (3008, [1e-300] * 16), (3009, [1e300] * 16)]
    return out


def brute_links(data, cosine):
    ok = {i: np.array(v, dtype=float) for i, v in data if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and float(unit[i] @ unit[j]) >= cosine} for i in unit}
    comp = {i: i for i, _ in data}
    for i in sorted(unit):
        if comp[i] == i:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                comp[j] = min(seen)
    return {(i, len(links.get(i, ())), comp[i], comp[i] == i) for i, _ in data}


@pytest.mark.parametrize(("cosine", "interval"), [(0.9, 4096), (0.9, 64), (0.99, 10)])
def test_links_equal_brute_force(spark, cosine, interval):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "d": F.lit(2), "rep": F.lit(3), "k": F.lit(4)})
    got = embeddings.near_duplicates(df.repartition(3), cosine, interval=interval).collect()
    assert {tuple(r) for r in got} == brute_links(vectors(), cosine) and len(got) == len(vectors())


def test_links_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("kind", "most"), [("even", 0.02), ("clusters", 0.26)])
def test_most_pairs_are_never_taken_in_full(kind, most):
    """Even vectors of 64 dimensions, the worst case, and clusters: leaves are skipped by their boxes, pairs by
    their bound; what is left has all links."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4096, 64))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(64, 64)), 64, axis=0) + 0.15 * x
    x = embeddings._unit(x)
    axes = embeddings.principal(x)
    x = x[np.lexsort(np.floor(x @ axes[:, : embeddings.LEADING] / 0.45).T[::-1])]
    q, one = embeddings.reduced(x, axes), np.ones(len(x), np.int64)
    deg, _, _, _, (visited, full) = embeddings.join_blocks(x, one, q, x, one, q, True, 0.9, np.sqrt(0.2))
    assert deg.tolist() == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
    assert full <= most * len(x) ** 2 / 2 and visited <= len(x) ** 2


def test_distant_intervals_are_skipped():
    low = np.array([[float(i)] for i in range(100)])
    tree = embeddings.Intervals(low, low + 0.5)
    assert tree.near(10, 0.6).tolist() == [10, 11] and tree.near(99, 5.0).tolist() == [99]


# ---------------------------------------------------------------- shared pieces


def test_heavy_groups_are_broadcast_and_all_rows_join(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(300)], "i int, k int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("last"))
    got = common.join_groups(rows, groups, "k", "n", 300, how_many=20).collect()
    assert sorted(r["i"] for r in got) == list(range(300)) and all(r["n"] == (100 if r["k"] == 0 else 1) for r in got)


def test_batch_size_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), common.text_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ranks_across_partitions(spark):
    df = spark.createDataFrame([(g, i % 7, i) for i in range(500) for g in ("a", None) if i % 3 or g], "g string, x int, i int")
    got = common.global_rank(df, ["g"], ["x", "i"], "r", weight="x").toPandas()
    for _, p in got.groupby(got["g"].fillna("null")):
        p = p.sort_values(["x", "i"])
        assert p["r"].tolist() == np.r_[0, np.cumsum(p["x"])[:-1]].tolist()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_registered_queries_equal_duckdb(spark):
    import __spark_entry__ as entry

    con = views(DATA)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name.startswith("op") and name[2].isdigit():
            got = of_spark(query(spark, DATA))
            assert len(got[1])
            if name in sql:
                assert got == of_duckdb(con, sql[name]), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_pipeline_keeps_columns_and_applies_every_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in p.STAGES:
        out = common.materialize(stage(spark, docs, DATA), "stage")
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out.count())
        if name == "exact dedup":
            assert out.select("text").distinct().count() == out.count()
        if name == "n-gram Jaccard join":
            from tickloom.llm import ngrams

            assert ngrams.jaccard_components(out, 5, 80).where("doc_id <> component_id").count() == 0
        docs = out
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0 and seen[4] == seen[5] > 0
