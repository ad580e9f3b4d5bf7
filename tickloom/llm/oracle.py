"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP6 = f"""
WITH d AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS c0, coalesce(sum(w) OVER before, 0) AS w0, sum(source_size) OVER () * 1.5::DOUBLE AS t, sum(w) OVER () AS ws
  FROM n WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap * (ws - w0) <= (t - c0) * w AS capped FROM c),
f AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS fc, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS fw FROM k),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (t - fc) * w / fw END AS target,
  ('0x' || substr(md5('0:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d),
x AS (SELECT r.doc_id, r.size, g.source_size, g.target, g.u, r.k, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((floor((k + 1) * e + u) - floor(k * e + u)) * size)::BIGINT AS taken FROM x
"""

OP7 = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM p),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT k, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v FROM q, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN m USING (k)
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _shards(shards: int = 24) -> str:
    """The same cuts by dynamic programming over all pairs of group ends: least largest shard, then
    greatest smallest one, then the cuts from the last to the first, each shard close to its share."""
    steps = ["m0 AS (SELECT 0 AS p, 0 AS big)"]
    steps += [f"m{k} AS MATERIALIZED (SELECT e.p, min(greatest(m.big, e.p - m.p)) AS big FROM e JOIN m{k - 1} m ON m.p < e.p GROUP BY e.p)" for k in range(1, shards + 1)]
    steps.append(f"c AS MATERIALIZED (SELECT big FROM m{shards} WHERE p = (SELECT max(p) FROM e))")
    steps.append("f0 AS (SELECT 0 AS p, 9000000000000000000 AS small)")
    steps += [f"f{k} AS MATERIALIZED (SELECT e.p, max(least(f.small, e.p - f.p)) AS small FROM e JOIN f{k - 1} f ON f.p < e.p JOIN c ON e.p - f.p <= c.big GROUP BY e.p)" for k in range(1, shards + 1)]
    steps.append(f"l AS MATERIALIZED (SELECT small FROM f{shards} WHERE p = (SELECT max(p) FROM e))")
    steps.append(f"x{shards} AS (SELECT max(p) AS p FROM e)")
    steps += [f"x{k} AS MATERIALIZED (SELECT arg_min(f.p, abs((x.p - f.p) * greatest(1, {k + 1} - e.huge_n) - (x.p - e.huge_b)) * 2 + ((x.p - f.p) * greatest(1, {k + 1} - e.huge_n) < x.p - e.huge_b)::INT) AS p FROM x{k + 1} x JOIN e ON e.p = x.p, c, l, f{k} f WHERE f.small >= l.small AND x.p - f.p BETWEEN l.small AND c.big)" for k in range(shards - 1, 0, -1)]
    cuts = " UNION ALL ".join(f"SELECT p FROM x{k}" for k in range(1, shards))
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, coalesce(octet_length(encode(text)), 0) + 8 AS size FROM documents),
g AS MATERIALIZED (SELECT t, min(doc_id) AS gid, sum(size)::HUGEINT::BIGINT AS size FROM d GROUP BY t),
e0 AS (SELECT t, gid, size AS s, CASE WHEN size > (SELECT sum(size)::BIGINT FROM g) // {shards} THEN size ELSE 0 END AS b FROM g),
e AS MATERIALIZED (SELECT t, s, (sum(s) OVER w)::BIGINT AS p, (sum(b) OVER w)::BIGINT AS huge_b, count(CASE WHEN b > 0 THEN 1 END) OVER w AS huge_n FROM e0 WINDOW w AS (ORDER BY gid)),
{", ".join(steps)}, cuts AS ({cuts}),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
crc AS MATERIALIZED (SELECT t, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM g, tab),
placed AS (SELECT doc_id, d.size, d.t, (SELECT count(*) FROM cuts WHERE cuts.p <= e.p - e.s) AS shard FROM d JOIN e ON d.t = e.t)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard, (SELECT big FROM c) AS capacity FROM placed JOIN crc USING (t)"""


#: Documents in classes of equal shingle sets or texts, links between pairs, and their closure.
OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
both_ways AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS to_ FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN both_ways b ON r.to_ = b.u)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8 = """
WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
q AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len_ FROM d WHERE ok),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.len_ * b.len_) >= 0.9),
r AS (SELECT vec_id, vec_id AS to_ FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.to_ = l.u),
c AS (SELECT vec_id, min(to_) AS component_id FROM r GROUP BY vec_id), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.u = c.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minimax_shards": _shards(), "op5_ngram_jaccard": OP5, "op8_grid_order_join": OP8, "op6_systematic_mix": OP6, "op7_url_rules": OP7, "op10_fuse_dedup": OP10}
