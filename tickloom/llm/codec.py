"""Adaptive context-mixing range coder for token ids, and the block files that hold them.

A block is coded by many lanes side by side: lane i has the i-th stretch of the block's ids, and
step t codes the t-th id of every lane with numpy operations over all lanes.  Lanes share one
adaptive model, which is updated after each step, in lane order, in the same way by encoder and
decoder.  The model of an id x after (.., p2, p1):

* order 2: the id last confirmed after the hash of (p2, p1), with a confidence from 0 to 7;
* order 1: the same after p1;
* order 0: adaptive counts of all ids.

Both confidences, and whether the two predictions agree, choose a context whose past successes
mix the three orders into one distribution: order 2 hits, order 1 hits, neither (then order 0).  A
carry-less range coder with 64-bit state, one for each lane, takes the resulting interval.

Block: magic, version, header, id table, lane lengths, words of all lanes, CRC-32 of all before it.
The header also has a CRC-32 of the ids.  Each block starts from a fresh model and can be decoded
alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, sole_cache, text_batches
from .tokens import batches

MAGIC, VERSION = b"TLRC", 1
HEAD = struct.Struct("<4sBBHIIIIIIII")
TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 40)
U16, U32, U48, ONE, LOW32 = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(1), np.uint64(2**32 - 1)
MIX_BITS, HASH_BITS, GAIN, LANES, STRETCH = 12, 18, 16, 8192, 128
BITS0, NEAR = 24, 8
BLOCK_TOKENS = 1 << 20
#: What is added to a prediction, by its confidence: eight steps if it was wrong, eight if it was right.
STEP = np.array([(c >> 1) - c for c in range(8)] + [1] * 7 + [0], dtype=np.int32)
#: White space, Unicode's and Python's, for Arrow's regular expressions.
ODD_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class _Model:
    """Predictions are kept as id * 8 + confidence.  Ids of past steps enter the order-0 counts when
    its table is rebuilt, ever less often."""

    def __init__(self, vocab: int):
        self.vocab = vocab
        self.two, self.one = np.zeros(1 << HASH_BITS, dtype=np.int32), np.zeros(vocab, dtype=np.int32)
        self.hits = np.ones(384, dtype=np.int64)
        self.count, self.ramp = np.zeros(vocab, dtype=np.int64), np.arange(vocab + 1, dtype=np.uint64)
        self.sums, self.cum, self.shares = np.zeros(vocab + 1, np.uint64), np.zeros(vocab + 1, np.uint64), np.zeros(vocab, np.uint64)
        self.ends = self.cum[1:]
        self.hash: np.ndarray | np.uint32 = np.uint32(0)
        self.past: list[np.ndarray] = []
        self.steps = self.next = 0
        self._mix()
        self._order0()

    def _mix(self) -> None:
        """Start and width of each choice, three to a context, among a context's 4096 slots."""
        hits = self.hits.reshape(128, 3)
        total, room = hits.sum(axis=1), (1 << MIX_BITS) - 3
        first = 1 + hits[:, 0] * room // total
        cuts = np.stack([0 * first, first, first + 1 + hits[:, 1] * room // total, 0 * first + (1 << MIX_BITS)], axis=1).astype(np.uint64)
        self.start, self.width = cuts[:, :3].ravel(), np.diff(cuts, axis=1).ravel()

    def _order0(self) -> None:
        """Sums of the order-0 shares, in units of 2**-BITS0, one at least for each id; shares has an id's
        sum before it in the upper half and its own share in the lower."""
        if self.past:
            self.count += np.bincount(np.concatenate(self.past), minlength=self.vocab)
            self.past = []
        sums, cum = self.sums, self.cum
        np.cumsum(self.count.view(np.uint64), out=sums[1:])
        np.multiply(sums, np.uint64(GAIN), out=cum)
        cum += self.ramp  # each id counts once from the start
        total = cum[-1]
        cum *= np.uint64((1 << BITS0) - self.vocab)
        cum //= total
        cum += self.ramp
        np.subtract(cum[1:], cum[:-1], out=self.shares)
        self.shares |= cum[:-1] << U32
        self.near = None
        self.next = self.steps + 1 + self.steps // 16

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose share holds v: a table gives the first id of v's stretch, most ids are there or
        one further, and only the others are searched for."""
        if self.near is None:
            self.near = np.cumsum(np.bincount((self.ends.view(np.int64) + (1 << NEAR) - 1) >> NEAR, minlength=1 << (BITS0 - NEAR)))
        at = self.near.take((v >> np.uint64(NEAR)).view(np.int64))
        more = np.flatnonzero(self.ends.take(at) <= v)
        at[more] += 1
        more = more[self.ends.take(at.take(more)) <= v.take(more)]
        if len(more):
            at[more] = np.searchsorted(self.ends, v[more], side="right")
        return at

    def look(self, p1: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both predictions after p1 (low: the same in 32 bits) and the one before it, and the place of
        the context's first choice; keeps what learn() needs."""
        low = low.view(np.uint32)
        self.at2, self.at1 = (((self.hash + low * np.uint32(0x85EBCA77)) >> np.uint32(7)) & np.uint32((1 << HASH_BITS) - 1)).astype(np.int64), p1
        self.hash = low * np.uint32(0x9E3779B1)
        self.v2, self.v1 = self.two.take(self.at2), self.one.take(p1)
        self.c2, self.c1 = self.v2 & 7, self.v1 & 7
        a, b = self.v2 >> 3, self.v1 >> 3
        return a, b, (self.c2 * 48 + self.c1 * 6 + (a == b) * np.int32(3)).astype(np.int64)

    def learn(self, x: np.ndarray, low: np.ndarray, choice: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """x came (low: the same in 32 bits), by this choice; hit: where a prediction was right."""
        self.hits += np.bincount(choice, minlength=384)
        fresh = low << 3
        for table, at, v, c, hit in ((self.two, self.at2, self.v2, self.c2, hit2), (self.one, self.at1, self.v1, self.c1, hit1)):
            state = c + (hit.view(np.int8) << 3)
            new = v + STEP.take(state)
            np.copyto(new, fresh, where=state <= 1)
            table[at] = new
        self.past.append(x)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self._mix()
        if self.steps >= self.next:
            self._order0()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STRETCH))
    return lanes, -(-n // lanes)


def _open(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Where a coder has a word to shift out."""
    return ((low ^ (low + rng)) < TOP) | (rng < BOT)


def _shift(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and range after a word was shifted out."""
    return low << U16, np.where((low ^ (low + rng)) < TOP, rng, (~low + ONE) & (BOT - ONE)) << U16


def encode_ids(ids: np.ndarray, vocab: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(lanes, steps, words of each lane, all words as uint16) for ids below vocab."""
    n = len(ids)
    if not n:
        return 0, 0, np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, low, rng = _Model(vocab), np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    room = steps * 3 + 8
    out, begin = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
    at, p1, q1 = begin.copy(), np.zeros(lanes, np.int64), np.zeros(lanes, np.int32)
    for q in grid:
        x = q.astype(np.int64)
        a, b, first = model.look(p1, q1)
        hit2, hit1 = q == a, q == b
        which = ~hit2 * (np.int8(2) - hit1.view(np.int8))
        choice, miss = first + which, which == 2
        r = rng >> np.uint64(MIX_BITS)
        low += r * model.start.take(choice)
        rng = r * model.width.take(choice)
        share, r0 = model.shares.take(x), rng >> np.uint64(BITS0)
        low += r0 * (share >> U32) * miss
        rng = np.where(miss, r0 * (share & LOW32), rng)
        go = np.flatnonzero(_open(low, rng))
        while len(go):
            lo, to = low.take(go), at.take(go)
            out[to] = lo >> U48
            at[go] = to + 1
            lo, rg = _shift(lo, rng.take(go))
            low[go], rng[go] = lo, rg
            go = go[_open(lo, rg)]
        model.learn(x, q, choice, hit2, hit1)
        p1, q1 = x, q
    last = (low + np.uint64(2**32 - 1)) >> U32
    out[at] = last >> U16
    out[at + 1] = last & np.uint64(0xFFFF)
    pos = at + 2 - begin
    return lanes, steps, pos.astype(np.uint32), out.reshape(lanes, room)[np.arange(room) < pos[:, None]]


def decode_ids(n: int, vocab: int, lanes: int, steps: int, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([words, np.zeros(steps * 3 + 16, np.uint16)])
    end = np.cumsum(lengths.astype(np.int64))
    pos = end - lengths

    def take(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.where(at < stop, padded.take(at), np.uint16(0)).astype(np.uint64)

    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << U16) | take(pos, end)
        pos = pos + 1
    model, low, rng = _Model(vocab), np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    p1, q1 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int32)
    last0 = np.uint64((1 << BITS0) - 1)
    for t in range(steps):
        a, b, first = model.look(p1, q1)
        r, left = rng >> np.uint64(MIX_BITS), code - low
        over = left >= r * model.start.take(first + 1)
        miss = left >= r * model.start.take(first + 2)
        choice = first + over + miss
        skip = r * model.start.take(choice)
        low += skip
        left -= skip
        rng = r * model.width.take(choice)
        r0 = rng >> np.uint64(BITS0)
        x = model.find(np.minimum(left // r0, last0))
        share = model.shares.take(x)
        low += r0 * (share >> U32) * miss
        rng = np.where(miss, r0 * (share & LOW32), rng)
        q = np.where(miss, x, np.where(over, b, a)).astype(np.int32)
        go = np.flatnonzero(_open(low, rng))
        while len(go):
            at = pos.take(go)
            code[go] = (code.take(go) << U16) | take(at, end.take(go))
            pos[go] = at + 1
            lo, rg = _shift(low.take(go), rng.take(go))
            low[go], rng[go] = lo, rg
            go = go[_open(lo, rg)]
        grid[t] = q
        x = q.astype(np.int64)
        model.learn(x, q, choice, q == a, q == b)
        p1, q1 = x, q
    return grid.T.reshape(-1)[:n]


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """One block file.  ids are those of all documents, in order; a null id keeps a flag."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    lanes, steps, words, body = encode_ids(raw, vocab)
    table = np.array([d or 0 for d in doc_ids], dtype="<i8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    docs = zlib.compress(np.diff(table, prepend=0).astype("<i8").tobytes() + np.asarray(lengths, dtype="<u4").tobytes() + nulls.tobytes(), 1)
    sizes = zlib.compress(words.astype("<u4").tobytes(), 1)
    head = HEAD.pack(MAGIC, VERSION, 0, 0, len(doc_ids), len(raw), vocab, lanes, steps, len(docs), len(sizes), zlib.crc32(raw.tobytes()))
    block = head + docs + sizes + body.astype("<u2").tobytes()
    return block + struct.pack("<I", zlib.crc32(block))


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids as uint32) of a block; ValueError if it is damaged."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum does not match")
    magic, version, _, _, n_docs, n, vocab, lanes, steps, n_table, n_sizes, crc = HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    at = HEAD.size
    docs = zlib.decompress(block[at : at + n_table])
    sizes = np.frombuffer(zlib.decompress(block[at + n_table : at + n_table + n_sizes]), dtype="<u4")
    words = np.frombuffer(block[at + n_table + n_sizes : -4], dtype="<u2")
    table = np.cumsum(np.frombuffer(docs, dtype="<i8", count=n_docs))
    lengths = np.frombuffer(docs, dtype="<u4", count=n_docs, offset=8 * n_docs)
    nulls = np.unpackbits(np.frombuffer(docs, dtype=np.uint8, offset=12 * n_docs), count=n_docs)
    raw = np.ascontiguousarray(decode_ids(n, vocab, lanes, steps, sizes, words), dtype="<u4")
    if zlib.crc32(raw.tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return [None if z else int(d) for d, z in zip(table, nulls, strict=True)], lengths, raw


class Encoder:
    """Texts to ids by the tokenizers library.  Pieces between spaces are encoded once and kept,
    up to a bound: byte-level pre-tokens start at a space that something other than white space
    follows.  Texts with other spacing, or with a special token's string, go through the library
    whole.

    What is kept are packed arrays, of the pieces and of their ids, and no objects: these take
    several times as much of a worker's memory."""

    KEEP, KEEP_BYTES = 1_200_000, 64 << 20

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        self.type = np.dtype("<u2" if self.vocab <= 65536 else "<u4")
        specials = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join([f" [{ODD_SPACE}]", " $", *specials])
        self._forget()
        space = self.tok.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(self.vocab, dtype=bool)
        self.opens[[i for t, i in self.tok.get_vocab().items() if t.startswith(space)]] = True

    def _run(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and the number of each one's, encoded in one text, a space before each; only a piece's
        first token has a space."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        ids = np.array(self.tok.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype=self.type)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(pieces):
            raise ValueError(f"{len(pieces)} pieces gave {len(at)}")
        return ids, np.diff(at, append=len(ids))

    def _forget(self) -> None:
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, self.type), np.zeros(0, np.int64)

    def _keep(self, rows: np.ndarray) -> None:
        """Keeps these of the known pieces alone."""
        begin = np.cumsum(self.sizes) - self.sizes
        self.known, self.ids, self.sizes = self.known.take(pa.array(rows)), self.ids[_spread(begin[rows], self.sizes[rows])], self.sizes[rows]

    def _find(self, names: pa.Array) -> np.ndarray:
        """The place of each name among the known pieces, which then hold all of them; -1 for an empty one."""
        names = names.cast(pa.string())
        at = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero((at < 0) & (pc.binary_length(names).to_numpy() > 0))
        if len(self.known) + len(new) > self.KEEP or self.known.nbytes > self.KEEP_BYTES:
            found = np.flatnonzero(at >= 0)
            self._keep(at[found])
            at[found] = np.arange(len(found))
        at[new] = len(self.known) + np.arange(len(new))
        fresh = names.take(pa.array(new))
        made = [self._learn(fresh.slice(k, 50_000)) for k in range(0, len(new), 50_000)]
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids, self.sizes = (np.concatenate([old, *x]) for old, x in zip((self.ids, self.sizes), zip(*made, strict=True) if made else ((), ()), strict=True))
        return at

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, packed.  Pieces are split and numbered by Arrow kernels, each distinct one is
        looked up once, and the ids of all texts are gathered in one numpy step."""
        sole_cache("ids", self._forget)
        odd = pc.match_substring_regex(texts, self.whole)
        plain = texts.filter(pc.invert(odd))
        whole = iter(self._run(texts.filter(odd).to_pylist()))
        rest = iter(self._plain(plain)) if len(plain) else iter(())
        return [next(whole) if o else next(rest) for o in odd.to_pylist()]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        pieces = lists.flatten()
        heads = self._run(pieces.take(pa.array(first)).to_pylist())
        numbered = pieces.dictionary_encode()
        place = self._find(numbered.dictionary)
        width, n = self.type.itemsize, len(self.known)
        which = place[numbered.indices.to_numpy()]
        which[first] = n + np.arange(len(first))  # a text's first piece has no space before it
        sizes = np.r_[self.sizes, np.fromiter(map(len, heads), np.int64, len(heads)) // width]
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(heads), dtype=self.type)])
        take = sizes[which]
        ends = np.cumsum(take)
        out = ids[_spread((np.cumsum(sizes) - sizes)[which], take)]
        stop = np.r_[ends[first[1:] - 1], ends[-1]]
        raw = out.tobytes()
        return [raw[i * width : j * width] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, .. of runs of these sizes, one run after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(begin.max(initial=0)) + total) < 2**31 else np.int64
    out = np.repeat((begin - (ends - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _by_id(docs: DataFrame, parts: int) -> DataFrame:
    """docs in ranges of doc_id, nulls in the first.  Bounds come from the id column alone: dealing rows
    out by range would read all texts once more for its sample."""
    id_ = F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).cast("double")
    bounds = docs.select(id_.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) < 3:
        return docs.coalesce(1)
    named = docs.withColumn("_x", id_)
    return Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(named).repartitionById(len(splits) - 1, F.col("_b").cast("int")).drop("_x", "_b")


def write_blocks(docs: DataFrame, path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and writes block files in ascending id order; returns them as
    (part, seq, before, n_docs, n_tokens, block): partition, number and tokens before it in there.

    Null text counts as empty: its ids are the end id alone.  Null ids come first.  Repeated ids
    are documents of their own.  A block takes whole documents until it has ``block_tokens`` ids, so
    a longer document is a block of its own.  An empty table gives no blocks.
    Partitions are ranges of ids, dealt out before the costly encoding; there are fewer of them where
    each would have less text than ``block_tokens`` bytes, as small blocks start their models anew.
    The rows are stored as Parquet by Spark's committer: a lost task leaves nothing behind.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = _by_id(slim, max(1, min(partitions(docs.sparkSession), size // block_tokens))).sortWithinPartitions("doc_id")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.binary())])

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        tail = np.array([end_id], dtype=enc.type).tobytes()
        names, lens, held, size, seq, before = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=enc.type)
            block = pack_block(names, np.array(lens), ids, enc.vocab)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_docs": len(names), "n_tokens": len(ids), "block": block}], schema=schema)

        for b in batches(table, "text", 24 << 20):
            for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                n = len(ids) // enc.type.itemsize + 1
                if names and size + n > block_tokens:
                    yield flush()
                    before, seq = before + size, seq + 1
                    names, lens, held, size = [], [], [], 0
                names.append(d)
                lens.append(n)
                held += [ids, tail]
                size += n
        if names:
            yield flush()

    with text_batches(docs.sparkSession, 10000):  # the more texts, the fewer distinct pieces to look up
        return materialize(ordered.mapInArrow(run, "part long, seq long, before long, n_docs long, n_tokens long, block binary"), "blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from block rows."""
    # one row for each partition that was written: a small table
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = sums.select("part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("first"))

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            for k in range(b.num_rows):
                names, lens, raw = unpack_block(b.column(2)[k].as_py())
                ends = np.cumsum(lens.astype(np.int64))
                starts = ends - lens
                view = memoryview(raw.tobytes())
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * n, pa.int64()), pa.array(names, pa.int64()), pa.array(starts + b.column(1)[k].as_py(), pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "before", "block").mapInArrow(run, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) decoded from block rows, for use in training."""

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            for block in b.column(0):
                names, lens, raw = unpack_block(block.as_py())
                offsets = np.r_[0, np.cumsum(lens.astype(np.int64))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pc.cast(pa.array(raw), pa.int32()))], ["doc_id", "ids"])

    return blocks.select("block").mapInArrow(run, "doc_id long, ids array<int>")
