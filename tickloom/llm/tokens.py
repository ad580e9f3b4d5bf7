"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import materialize, sole_cache, text_batches, trim

NONE = np.int64(2**62)
CACHE = 1_000_000
#: White space of the tokenizer's normalizer and of str.split differ in these.
_ODD = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class WordCounter:
    """Counts the tokens of a word-end BPE (``tokenizers`` JSON): NFC, lower case, a split pattern,
    byte symbols, the last one with the word-end suffix, then merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        self.inner = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.stop = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token.

        All pre-tokens are one array of symbols with a sequence number each.  In a step every
        sequence finds its lowest rank and merges all its pairs of that rank, left to right; a new
        symbol cannot make a pair of lower rank than its own.  Ranks are looked up again only
        beside merged symbols, and finished sequences leave the arrays.
        """
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        out = lens.copy()
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        if not len(data):
            return out
        sym = self.inner[data]
        ends = np.cumsum(lens)[lens > 0] - 1
        sym[ends] = self.last[data[ends]]
        seq = np.repeat(np.arange(len(pieces)), lens)
        rank = np.full(len(sym), NONE)
        rank[:-1] = np.where(seq[:-1] == seq[1:], self._rank(sym[:-1], sym[1:]), NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            long = np.diff(np.r_[starts, len(sym)])
            done = best == NONE
            out[seq[starts[done]]] = long[done]
            if done.any():
                stay = np.repeat(~done, long)
                sym, seq, rank, best, long = sym[stay], seq[stay], rank[stay], best[~done], long[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, long)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # aaa: every other pair of a run
                first = np.r_[True, np.diff(at) != 1]
                begin = np.maximum.accumulate(np.where(first, at, 0))
                at = at[(at - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            new = np.cumsum(stay)[at] - 1
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            touched = np.unique(np.r_[new, new[new > 0] - 1])
            right = np.minimum(touched + 1, len(sym) - 1)
            same = (seq[touched] == seq[right]) & (right > touched)
            rank[touched] = np.where(same, self._rank(sym[touched], sym[right]), NONE)
        return out

    def chunks(self, text: str) -> list[str]:
        """Normalised runs of other than white space; the pattern never spans white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()

    def _forget(self) -> None:
        self.known = {}

    def _learn(self, missing: list[str]) -> None:
        found = [self.pattern.findall(c) for c in missing]
        pieces = list(dict.fromkeys(p for f in found for p in f))
        count = dict(zip(pieces, self.merge_counts([p.encode() for p in pieces]).tolist(), strict=True))
        self.known.update((c, sum(count[p] for p in f)) for c, f in zip(missing, found, strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, special strings one each.  Counts of chunks are remembered up to a bound."""
        sole_cache("word counts", self._forget)
        parts, extra = [], []
        for t in texts:
            t = t or ""
            found = self.stop.findall(t) if self.stop and "<" in t else []
            extra.append(len(found))
            parts.append([c for piece in self.stop.split(t) for c in self.chunks(piece)] if found else self.chunks(t))
        need: set[str] = set()
        for p in parts:
            need.update(p)
        missing = need.difference(self.known)
        if len(self.known) + len(missing) > CACHE:
            self.known = {c: self.known[c] for c in need.intersection(self.known)}  # frequent ones stay
        todo = list(missing)
        for i in range(0, len(todo), 200_000):
            self._learn(todo[i : i + 200_000])
        get = self.known.__getitem__
        return [n + sum(map(get, p)) for n, p in zip(extra, parts, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def batches(table: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with about ``most`` bytes of text, one row at least."""
    for b in table:
        at = b.schema.get_field_index(column)
        text = b.column(at)
        lens = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        part = np.cumsum(lens) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(lens)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(int(i), int(j - i))
    trim()


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    Null text counts as empty: 0 and 0.  Repeated rows give repeated rows, an empty table none.
    Only the two columns named are read, so other columns may have any names.  Texts of any length are counted whole;
    a partition is taken in slices of bounded text.  path is that of a tokenizer JSON file present
    on all executors.  The counts are written once, slim, to the shared folder.
    """

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches(table, "text"):
            texts = b.column(1).to_pylist()
            n = pa.array(c.counts(texts), pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    with text_batches(docs.sparkSession):
        return materialize(slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"), "counts")
