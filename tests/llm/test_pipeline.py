"""The pipeline against a brute-force twin of all five stages."""

import hashlib
import math
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from test_documents import SCHEMA, brute_components, brute_distance, text
from tokenizers import Tokenizer

from tickloom.llm import toxicity

QUOTES = "\"“”„«»"


def corpus(seed):
    """Documents with toxic, quoted and misspelt ones, copies, near copies, odd ids and texts; and labels."""
    r = random.Random(seed)
    data, labels = [], []
    for i in range(360):
        words = text(seed * 1000 + i, r.randint(30, 90)).split()
        bad = i % 6 == 0
        if bad:
            for k in r.sample(range(len(words)), 5):
                words[k] = r.choice(["blorgon", "snarfle", "zemitu" + r.choice("abcdef") * 2])
        data.append((i, " ".join(words), i % 4))
        labels.append((i, 1, int(bad)))
    base = [t for i, t, _ in data if i % 6 and i < 60]
    for k, t in enumerate(base):
        words = t.split()
        data += [(1000 + 10 * k + j, t, k % 4) for j in range(k % 4)]
        for j in range(k % 3):
            words[-1 - j] = words[j] = "other" + "ab"[j]
            data.append((2000 + 10 * k + j, " ".join(words), j))
    data += [(3000 + k, " ".join(text(k, 40).split() + [w]), 1) for k, w in enumerate(["blorgno", "snarfl snarffle blogron snafrle", '"blorgon"', "« snarfle »", "zemutuaa zemitubb zemiutff"])]
    one, two, three = (text(seed * 1000 + 900 + k, 50) for k in range(3))
    # a repeated id with one near copy and one text of its own; null ids near another and near each other
    data += [(4000, one, 0), (4001, one + " more", 0), (4001, two, 1), (None, two + " more still", 2), (None, three, 1), (None, three + " more", 3), (4002, three + " more yet again", 3)]
    data += [(5000, None, 0), (5001, "", 1), (5002, " \n", 2), (5003, "one", 3), (5004, "ONE", 3), (5005, "a b c", 0), (5006, "x " * 12000 + "y", 1)]
    r.shuffle(data)
    return [(i, t, "en", [None, "a", "b", "c"][s], n) for n, (i, t, s) in enumerate(data)], labels


def kind(word, terms, stems):
    """The kind of match, by edit distances to the whole lexicon."""
    near = lambda w, t: len(t) >= 5 and w[:1] == t[0] and brute_distance(w[1:], t[1:]) <= 1
    if word in terms:
        return "exact"
    if any(word.startswith(s) for s in stems):
        return "stem"
    if any(near(word, t) for t in terms):
        return "fuzzy"
    return "fuzzy stem" if any(near(word[:k], s) for s in stems for k in range(len(s) - 1, len(s) + 2)) else None


def brute_score(t, terms, stems, weights, seen):
    tokens = re.findall(rf"\w+|[{QUOTES}]", (t or "").lower())
    words = [k for k, w in enumerate(tokens) if w not in QUOTES]
    outside, inside = [], 0
    for n, k in enumerate(words):
        if tokens[k] not in seen:
            seen[tokens[k]] = kind(tokens[k], terms, stems)
        if m := seen[tokens[k]]:
            before = sum(w in QUOTES for w in tokens[:k])
            if before % 2 and any(w in QUOTES for w in tokens[k + 1 : k + 11]):
                inside += 1
            else:
                outside.append((n, m))
    count = {m: sum(x == m for _, x in outside) for m in ("exact", "fuzzy", "stem", "fuzzy stem")}
    densest = max((sum(p <= q < p + 10 for q, _ in outside) for p, _ in outside), default=0)
    found = [math.log1p(c) for c in [*count.values(), inside, densest]]
    x = [1.0, *found, 100.0 * len(outside) / max(len(words), 30), float(count["exact"] + count["stem"] > 0)]
    if not outside and not inside:
        x = [1.0] + [0.0] * 8
    return 1.0 / (1.0 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True))))


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_mix(rows):
    """Copies of each row: targets by taking out capped sources one after the other, then running sums."""
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    total = {s: sum(size(x[1]) for x in by[s]) for s in order}
    left, free, target = 1.5 * sum(total.values()), list(order), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2.0 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            free.remove(s)
        left = 1.5 * sum(total.values()) - sum(target.values())
        if not free:
            break
    target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    out = []
    for s in order:
        each = target[s] / total[s] if total[s] else 0.0
        offset = int(hashlib.md5(("0:" + ("\0null" if s is None else s)).encode()).hexdigest()[:8], 16) / 2**32
        for k, row in enumerate(sorted(by[s], key=lambda x: (size(x[1]), x[0] is not None, x[0] or 0))):
            out += [row] * (math.floor((k + 1) * each + offset) - math.floor(k * each + offset))
    return out


def least_padding(lengths, buckets):
    """Least padding of sorted lengths in so many buckets, by the plain recurrence."""
    values = sorted(set(lengths))
    count = [lengths.count(v) for v in values]
    pad = lambda i, j: sum((values[j] - values[k]) * count[k] for k in range(i, j + 1))
    cost = {(i, j): pad(i, j) for j in range(len(values)) for i in range(j + 1)}
    best = [cost[0, j] for j in range(len(values))]
    for _ in range(buckets - 1):
        best = [min([best[j]] + [best[i - 1] + cost[i, j] for i in range(1, j + 1)]) for j in range(len(values))]
    return best[-1]


@pytest.mark.parametrize("odd_ids", [True, False])
def test_pipeline_equals_brute_force(spark, tmp_path, odd_ids):
    data, labels = corpus(3)
    if not odd_ids:
        data = [x for x in {x[0]: x for x in data if x[0] is not None}.values()]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    # the learned model is the operator's; what it finds in each text is found again here
    model = toxicity.train(docs, marks)
    terms, stems, seen = set(model.lexicon.terms), model.lexicon.stems, {}
    assert terms and stems
    scores = [brute_score(x[1], terms, stems, model.weights, seen) for x in data]
    rows = [x for x, s in zip(data, scores, strict=True) if s < 0.3]
    assert {"exact", "stem", "fuzzy"} <= set(seen.values()) and len(rows) < len(data) - 50
    stages = [len(rows)]

    last = {}
    for x in rows:
        t = x[1] or ""
        if t not in last or (last[t][0] is None, -(last[t][0] or 0)) > (x[0] is None, -(x[0] or 0)):
            last[t] = x
    rows = list(last.values())
    stages.append(len(rows))

    # components by position, in the order by which the first stays
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0))
    least = {k: c for k, _, c in brute_components([(k, x[1]) for k, x in enumerate(rows)], 5, 80)}
    rows = [x for k, x in enumerate(rows) if least[k] == k]
    stages.append(len(rows))
    assert sorted(stages, reverse=True) == stages and len(set(stages)) == 3
    ids = [x[0] for x in rows]
    if odd_ids:  # the repeated id keeps its own text, of each pair near a null id one stays
        assert ids.count(4001) == 1 and 4000 in ids and 4002 in ids and None not in ids

    rows = brute_mix(rows)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [len(lib.encode(x[1] or "", add_special_tokens=False).ids) for x in rows]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    flat = lambda a: sorted(a, key=lambda x: (x[0] is None, x))
    assert flat((r["doc_id"], r["n_tokens"]) for r in got) == flat((x[0], n) for x, n in zip(rows, lengths, strict=True))

    edges = sorted({r["boundary"] for r in got})
    assert len(edges) <= 16 and sum(r["padding"] for r in got) == least_padding(lengths, 16)
    want = []
    for b, edge in enumerate(edges):
        inside = sorted((x[0], n) for x, n in zip(rows, lengths, strict=True) if (edges[b - 1] if b else -1) < n <= edge)
        room = max(1, 65536 // max(1, edge))
        want += [(i, n, b, edge, k // room, k % room, edge - n) for k, (i, n) in enumerate(inside)]
    names = ("doc_id", "n_tokens", "bucket", "boundary", "batch", "slot", "padding")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
