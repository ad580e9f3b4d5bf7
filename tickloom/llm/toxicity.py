"""Toxicity scores from a lexicon matched with one edit, and the context of each match.

A lexicon trie is intersected with Levenshtein automata: a state is the set of (trie node, edits)
pairs that the characters read so far can reach, and states are made when first needed.  An edit
is a letter more, less or changed, or two neighbours swapped; halfway through a swap a pair also has
the letter that must come next.  A word runs through the resulting automaton once, whatever the
size of the lexicon, and most words reach the dead state after two or three characters.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sole_cache, text_batches, trim
from .tokens import batches

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
WINDOW = 10
LEAST_FUZZY = 5
KEEP = 300_000
EXACT, FUZZY, STEM, FUZZY_STEM = 1, 2, 3, 4
#: States beyond a stem: it was read as it is, or with an edit.
PAST, PAST_FUZZY = (-1, 0, ""), (-1, 1, "")


class FuzzyLexicon:
    """Whole terms and stems; a stem matches at the start of a word.  Both match exactly or, from LEAST_FUZZY
    letters on, with one edit after the first letter: few misspell that, and many other words differ
    in it alone.  Of several kinds of match, the first of EXACT, STEM, FUZZY, FUZZY_STEM counts."""

    def __init__(self, terms: list[str], stems: list[str], edits: int = 1):
        self.terms, self.stems, self.edits = list(terms), list(stems), edits
        self.child: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for word, at in [(t, self.term_at) for t in terms] + [(s, self.stem_at) for s in stems]:
            node = 0
            for c in word:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                node = self.child[node][c]
            at[node] = len(word)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0, "")}))

    def _closed(self, triples: set[tuple[int, int, str]]) -> frozenset:
        """With what is reached by leaving letters out, and past a stem once its end is reached."""
        todo = list(triples)
        while todo:
            node, e, swap = todo.pop()
            if node <= 0 or swap:
                continue
            more = [(k, e + 1, "") for k in self.child[node].values()] if e < self.edits else []
            if node in self.stem_at and (e == 0 or self.stem_at[node] >= LEAST_FUZZY):
                more.append(PAST_FUZZY if e else PAST)
            for t in more:
                if t not in triples:
                    triples.add(t)
                    todo.append(t)
        return frozenset(triples)

    def _state(self, triples: frozenset) -> int:
        if triples not in self.states:
            self.states[triples] = len(self.sets)
            self.sets.append(triples)
            self.next.append({})
            found = {STEM} if PAST in triples else {FUZZY_STEM} if PAST_FUZZY in triples else set()
            for node, e, swap in triples:
                if node in self.term_at and not swap and (e == 0 or self.term_at[node] >= LEAST_FUZZY):
                    found.add(FUZZY if e else EXACT)
            self.accept.append(next((k for k in (EXACT, STEM, FUZZY, FUZZY_STEM) if k in found), 0))
        return self.states[triples]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, e, swap in self.sets[state]:
            if node < 0:
                out.add((node, e, ""))
            elif swap:
                if c == swap:
                    out.add((node, e, ""))
            else:
                kids = self.child[node]
                if c in kids:
                    out.add((kids[c], e, ""))
                if node and e < self.edits:
                    out.add((node, e + 1, ""))
                    for letter, k in kids.items():
                        out.add((k, e + 1, ""))
                        if letter != c and c in self.child[k]:
                            out.add((self.child[k][c], e + 1, letter))
        to = self._state(self._closed(out))
        self.next[state][c] = to
        return to

    def match(self, word: str) -> int:
        """EXACT, FUZZY, STEM, FUZZY_STEM or 0."""
        state = self.start
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                return 0
        return self.accept[state]


class Scorer:
    """Matches, their contexts, and a logistic score.  weights None: not yet fitted."""

    N = 9

    def __init__(self, lexicon: FuzzyLexicon, weights: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights
        self.known: set[str] = set()
        self.bad: dict[str, int] = {}

    def _forget(self) -> None:
        self.known, self.bad = set(), {}

    def _learn(self, words: set[str]) -> None:
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > KEEP:
            self.known.clear()
            self.bad.clear()
            fresh = words
        match = self.lexicon.match
        for w in fresh:
            if m := match(w):
                self.bad[w] = m
        self.known |= fresh

    def features(self, text: str) -> np.ndarray:
        """1; matches by kind outside quotations (exact, one edit, stem, stem with one edit); matches inside;
        the most matches within a window; share of words; any exact match outside.

        A match is quotation if an odd number of quotation marks stands before it and another one
        follows within WINDOW words."""
        tokens = TOKEN.findall(text)
        kinds, inside, places, n = [0] * 5, 0, [], 0
        follow: list[int] = [i for i, t in enumerate(tokens) if t in QUOTES]
        k = 0
        for i, t in enumerate(tokens):
            if t in QUOTES:
                k += 1
                continue
            n += 1
            m = self.bad.get(t)
            if m:
                if k % 2 and k < len(follow) and follow[k] - i <= WINDOW:
                    inside += 1
                else:
                    kinds[m] += 1
                    places.append(n)
        densest = first = 0
        for j, p in enumerate(places):
            while p - places[first] >= WINDOW:
                first += 1
            densest = max(densest, j - first + 1)
        out = sum(kinds)
        return np.array([1.0, math.log1p(kinds[EXACT]), math.log1p(kinds[FUZZY]), math.log1p(kinds[STEM]), math.log1p(kinds[FUZZY_STEM]), math.log1p(inside), math.log1p(densest), 100.0 * out / max(n, 30), float(kinds[EXACT] + kinds[STEM] > 0)])

    def all_features(self, texts: list[str | None]) -> np.ndarray:
        sole_cache("toxic words", self._forget)
        low = [(t or "").lower() for t in texts]
        words = [set(WORD.findall(t)) for t in low]
        self._learn(set().union(*words))
        blank = np.array([1.0] + [0.0] * (self.N - 1))
        return np.array([self.features(t) if not self.bad.keys().isdisjoint(w) else blank for t, w in zip(low, words, strict=True)]).reshape(len(texts), self.N)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.all_features(texts) @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


#: Prior means of the weights: the fit stays near them where labels say little.
PRIOR = np.array([-2.5, 1.5, 1.0, 1.5, 0.5, -0.3, 0.3, 0.1, 1.5])
#: Signs that the weights keep: no match outside quotations lowers a score, no match inside raises it.
LEAST = np.array([-np.inf, 0.0, 0.0, 0.0, 0.0, -np.inf, 0.0, 0.0, 0.0])
GREATEST = np.array([np.inf, np.inf, np.inf, np.inf, np.inf, 0.0, np.inf, np.inf, np.inf])


def fit_weights(x: np.ndarray, y: np.ndarray, worth: np.ndarray | float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps over rows of so much ``worth``, with a Gaussian prior around PRIOR and
    weights of given signs: a weight at its bound leaves it only if the gradient points inside."""
    w, tight = np.clip(PRIOR, LEAST, GREATEST), np.array([0.05] + [0.5] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (worth * (y - p)) - tight * (w - PRIOR)
        free = np.flatnonzero(~(((w <= LEAST) & (slope < 0)) | ((w >= GREATEST) & (slope > 0))))
        curve = (x[:, free] * (worth * p * (1 - p))[:, None]).T @ x[:, free] + np.diag(tight[free])
        new = w.copy()
        new[free] = np.clip(w[free] + np.clip(np.linalg.solve(curve, slope[free]), -2, 2), LEAST[free], GREATEST[free])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


#: What a misspelt copy counts beside a labelled text.
SPOILT_WORTH = 0.2


def misspelt(word: str, k: int) -> str:
    """word with one edit inside: two letters swapped, one left out, doubled, or changed, by k."""
    i = 1 + k // 4 % max(1, len(word) - 2)
    a, b, c = word[:i], word[i : i + 1], word[i + 1 :]
    return [a[:-1] + b + a[-1:] + c, a + c, a + b + b + c, a + ("x" if b != "x" else "z") + c][k % 4]


def _spoilt(text: str, lexicon: FuzzyLexicon, k: int) -> str:
    """text in lower case with each match of the lexicon misspelt."""
    return WORD.sub(lambda m: misspelt(m[0], k + m.start()) if lexicon.match(m[0]) in (EXACT, STEM) else m[0], text.lower())


def fit(texts: list[str], toxic: list[int], lexicon: list[str]) -> Scorer:
    """A scorer with the terms and stems of labelled texts, and ``lexicon`` as terms besides.

    Labelled texts hardly misspell, so the weights are fitted with one more copy of each toxic text in
    which every match is misspelt: what an edit is worth is then weighed against the clean words that
    are an edit away from a term."""
    terms, stems = learn_lexicon(texts, toxic)
    terms = list(dict.fromkeys([*map(str.lower, lexicon), *terms]))
    scorer = Scorer(FuzzyLexicon(terms, stems), PRIOR.copy())
    if 0 < sum(toxic) < len(toxic):
        spoilt = [_spoilt(t, scorer.lexicon, k) for k, (t, y) in enumerate(zip(texts, toxic, strict=True)) if y]
        x = np.vstack([scorer.all_features((texts + spoilt)[i : i + 500]) for i in range(0, len(texts) + len(spoilt), 500)])
        y = np.array([*toxic, *[1] * len(spoilt)], dtype=float)
        seen = (x[:, 1:] != 0).any(axis=1)  # a misspelt copy without a match left says nothing
        use = np.arange(len(x)) < len(texts)
        scorer.weights = fit_weights(x[use | seen], y[use | seen], np.where(use, 1.0, SPOILT_WORTH)[use | seen])
    return Scorer(FuzzyLexicon(terms, stems), scorer.weights)


#: A stem counts as repeated in a text from so many of its words on.
OFTEN = 3


def _surprise(c: int, d: int, base: float) -> float:
    """Minus the log of about the chance that c or more of c + d texts are toxic (Chernoff)."""
    n, q = c + d, c / (c + d)
    return -1.0 if q <= base else n * (q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0.0))


def learn_lexicon(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str]]:
    """(terms, stems) that stand out in toxic texts.

    Candidates are whole words, their prefixes of 4 to 7 letters, and prefixes that several words of a
    text share, each by the number of texts.  One is kept if so many of its texts are toxic that
    chance would give less than 0.001 of that among all words and prefixes, or less than 0.1 among
    the few shared prefixes.  A stem must reach
    many more toxic texts than any whole word with it; it may occur in some clean texts, as its
    number of matches counts in the score.  There is no bound on either but that of the texts.
    """

    def kinds(t: str) -> tuple[set[str], set[str], set[str]]:
        words = Counter(w for w in WORD.findall(t.lower()) if len(w) >= 3 and not w.isdigit())
        heads: Counter = Counter()
        for w, k in words.items():
            for n in range(4, min(8, len(w))):
                heads[w[:n]] += min(k, 2)
        return set(words), set(heads), {h for h, k in heads.items() if k >= OFTEN}

    n_pos = sum(1 for y in toxic if y)
    if not n_pos or n_pos == len(toxic):
        return [], []
    base = n_pos / len(toxic)
    pos, neg = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for t in (t for t, y in zip(texts, toxic, strict=True) if y):
        for c, found in zip(pos, kinds(t), strict=True):
            c.update(found)
    all_ = len(pos[0]) + len(pos[1])
    need = [math.log(1000.0 * max(1, n)) for n in (all_, all_)] + [math.log(10.0 * max(1, len(pos[2])))]
    # with fewer toxic texts than that, none is surprising
    pos = [Counter({k: n for k, n in c.items() if n >= x / -math.log(base)}) for c, x in zip(pos, need, strict=True)]
    for t in (t for t, y in zip(texts, toxic, strict=True) if not y):
        for c, keep, found in zip(neg, pos, kinds(t), strict=True):
            c.update(found & keep.keys())

    def scored(i: int) -> dict[str, float]:
        return {k: x for k, c in pos[i].items() if (x := _surprise(c, neg[i][k], base)) > need[i]}

    terms = {w: x for w, x in scored(0).items() if pos[0][w] >= 4 * (neg[0][w] + 1)}
    top: Counter = Counter()
    for w, c in pos[0].items():
        for n in range(4, min(8, len(w))):
            top[w[:n]] = max(top[w[:n]], c)
    stems = {h: x for h, x in scored(1).items() if pos[1][h] >= neg[1][h] and pos[1][h] >= 2 * max(top[h], pos[0][h])}
    for h, x in scored(2).items():
        if pos[2][h] >= 4 * (neg[2][h] + 1) and pos[2][h] >= 2 * max(top[h], pos[0][h]):
            stems[h] = max(x, stems.get(h, x))
    kept: list[str] = []
    for h in sorted(stems, key=lambda h: (-stems[h], -len(h), h)):
        if not any(h.startswith(k) or k.startswith(h) for k in kept):
            kept.append(h)
    # a stem speaks for the words it begins, misspelt ones too if it is long enough
    words = [w for w in sorted(terms, key=lambda w: (-terms[w], w)) if not any(w.startswith(k) and len(k) >= LEAST_FUZZY for k in kept)]
    return words, kept


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, lexicon: list[str] = (), most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learns terms, stems and weights from at most ``most_rows`` labelled rows, drawn by a hash of
    the id from those not held out.  ``lexicon`` adds terms to those learned.

    Null labels and null ids are left out; of labels given twice, the larger holds, and of texts with
    the same id the least.  With no rows, or one class only, the prior weights stay and the lexicon is the one given."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    picked = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = picked.collect()
    few = spark.createDataFrame([(r[0], r[1]) for r in rows], picked.schema)  # bounded by most_rows
    table = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(few), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).orderBy("_id").select("_text", "_y").toArrow()
    texts, y = table.column(0).to_pylist(), [int(v > 0) for v in table.column(1).to_pylist()]
    scorer = fit(texts, y, list(lexicon))
    del table, texts
    trim()
    return scorer


_LOADED: dict[bytes, Scorer] = {}


def _load(state: bytes) -> Scorer:
    if state not in _LOADED:
        _LOADED.clear()
        terms, stems, weights = pickle.loads(state)
        _LOADED[state] = Scorer(FuzzyLexicon(terms, stems), weights)
    return _LOADED[state]


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs; the score sees nothing but the text.

    Null text scores as empty.  Repeated rows give repeated rows; an empty table none.  Whole texts
    are read, in slices of bounded size."""
    state = pickle.dumps((scorer.lexicon.terms, scorer.lexicon.stems, scorer.weights))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _load(state)
        for b in batches(table, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    with text_batches(docs.sparkSession):
        out = materialize(slim.mapInArrow(run, f"doc_id {kind}, score double"), "scores")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with all their columns, in one pass."""
    state = pickle.dumps((scorer.lexicon.terms, scorer.lexicon.stems, scorer.weights))

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _load(state)
        for b in batches(table, text_col):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array(s.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
