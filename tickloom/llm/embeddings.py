"""Cosine near-duplicates by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so links are pairs within epsilon.  Vectors are
projected on leading principal dimensions (fitted on a bounded sample; any rotation gives the same
links) and sorted by their epsilon grid cells there, first dimension first.  The sequence is cut
into intervals; a recursion over pairs of intervals skips those whose boxes are more than epsilon
apart, first between intervals (boxes alone), then inside a pair of intervals down to leaves.

In a leaf, what is left of a vector outside the leading dimensions counts by its length r: the
cosine of two vectors is at most p_a . p_b + r_a r_b (Cauchy-Schwarz), so most pairs are provably
below it from BOUND + 1 numbers each; only the others are taken in full, in double precision.  The
boxes too have r as one more dimension, in which near vectors are near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, global_rank, join_groups, materialize

#: Principal dimensions whose grid cells order the vectors, and those that bound a cosine.
LEADING, BOUND = 8, 16
#: Bytes of vectors in an interval; two of them meet in one task.
INTERVAL_BYTES = 1 << 23
LEAF = 512
#: A leaf's pairs are taken in full at once if more than this share of them is not provably distant.
DENSE = 0.05
MOST_INTERVALS = 1 << 16
FIT_ROWS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, k: int = BOUND) -> np.ndarray:
    """Columns: the leading principal dimensions of unit vectors."""
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, : min(k, sample.shape[1])]


def reduced(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the leading dimensions, and the length of the rest."""
    p = x @ axes
    return np.c_[p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))]


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Distance between boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return np.sqrt((gap * gap).sum(axis=-1))


class Intervals:
    """Boxes of consecutive stretches, in a binary tree over the sequence."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = [low], [high]
        while len(self.low[-1]) > 1:
            a, b = self.low[-1], self.high[-1]
            if len(a) % 2:
                a, b = np.vstack([a, a[-1:]]), np.vstack([b, b[-1:]])
            self.low.append(np.minimum(a[::2], a[1::2]))
            self.high.append(np.maximum(b[::2], b[1::2]))

    def near(self, i: int, eps: float) -> np.ndarray:
        """Stretches j >= i that may hold vectors within eps of stretch i, by recursion from the whole
        sequence."""
        lo, hi = self.low[0][i], self.high[0][i]
        now = np.zeros(1, dtype=np.int64)
        for level in range(len(self.low) - 1, -1, -1):
            now = now[now < len(self.low[level])]
            now = now[((now + 1) << level) > i]
            now = now[_apart(lo, hi, self.low[level][now], self.high[level][now]) <= eps]
            if level:
                now = np.concatenate([now * 2, now * 2 + 1])
        return np.sort(now)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for edges a-b among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _hits(xa: np.ndarray, qa: np.ndarray, xb: np.ndarray, qb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) of all pairs at the cosine or above, and how many pairs were taken in full."""
    i, j = np.nonzero(qa.astype(np.float32) @ qb.astype(np.float32).T >= cosine - 1e-5)  # far more than single precision loses
    if len(i) > DENSE * len(xa) * len(xb):
        return *np.nonzero(xa @ xb.T >= cosine), len(xa) * len(xb)
    near = np.einsum("ij,ij->i", xa[i], xb[j]) >= cosine
    return i[near], j[near], len(i)


def join_blocks(xa: np.ndarray, ka: np.ndarray, qa: np.ndarray, xb: np.ndarray, kb: np.ndarray, qb: np.ndarray, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(links of each a, links of each b, edges as a's index, b's index offset by len(a), pairs in leaves
    that were visited and pairs taken in full).

    x: unit vectors, k: copies of each, q: reduced vectors.  With ``same``, b is a and pairs count once."""
    na, nb = len(xa), len(xb)
    deg_a, deg_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    us, vs, visited, full = [], [], 0, 0

    def halves(i: int, j: int) -> list[tuple[int, int]]:
        middle = i + LEAF * (-(-(j - i) // LEAF) // 2)
        return [(i, j)] if j - i <= LEAF else [(i, middle), (middle, j)]

    def visit(a0: int, a1: int, b0: int, b1: int) -> None:
        nonlocal visited, full
        if same and b1 <= a0:
            return
        if _apart(qa[a0:a1].min(0), qa[a0:a1].max(0), qb[b0:b1].min(0), qb[b0:b1].max(0)) > eps:
            return
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            for x in halves(a0, a1):
                for y in halves(b0, b1):
                    visit(*x, *y)
            return
        if same and b0 < a0:
            return
        i, j, n = _hits(xa[a0:a1], qa[a0:a1], xb[b0:b1], qb[b0:b1], cosine)
        visited, full = visited + (a1 - a0) * (b1 - b0), full + n
        if same and a0 == b0:
            i, j = i[i != j], j[i != j]
        else:
            np.add.at(deg_b, b0 + j, ka[a0 + i])
        np.add.at(deg_a, a0 + i, kb[b0 + j])
        if len(i):
            w = a1 - a0
            root = _roots(i, j + w, w + b1 - b0)
            node = np.flatnonzero(root != np.arange(len(root)))
            where = np.r_[np.arange(a0, a1), na + np.arange(b0, b1)]
            us.append(where[node])
            vs.append(where[root[node]])

    visit(0, na, 0, nb)
    if same:
        deg_a += deg_b
        deg_b[:] = 0
    none = np.zeros(0, np.int64)
    u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
    if same:
        u, v = u % na, v % na
    root = _roots(u, v, na + nb)
    node = np.flatnonzero(root != np.arange(len(root)))
    return deg_a, deg_b, node, root[node], (visited, full)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", interval: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors are linked at cosine >= ``cosine``.

    n_links counts other rows linked directly, component_id is the smallest id reachable, kept says
    that it is the row's own.  Null vectors, empty and zero ones, and those with null or non-finite
    parts link with nothing.  Vectors of different length do not link.  Equal vectors are compared
    once and counted with their number of copies, so one vector may make up a third of the
    table.  Repeated ids are rows of their own.  Empty tables give no rows; other columns are not read.

    The driver holds two corners in BOUND + 1 dimensions for each interval.  An interval has
    INTERVAL_BYTES of vectors (or ``interval`` rows), more only where there would be over
    MOST_INTERVALS of them: the longer it is, the less a vector travels.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fine)
    distinct = materialize(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("k")), "distinct")
    kind = np.dtype("<f8") if "double" in distinct.schema["v"].dataType.simpleString() else np.dtype("<f4")
    count = distinct.groupBy(F.size("v").alias("d")).count().collect()
    n_rows = distinct.agg(F.sum("k")).first()[0] or 0
    axes, sizes = {}, {}
    for r in count:
        sizes[r["d"]] = max(interval or max(LEAF, INTERVAL_BYTES // (8 * r["d"])), -(-r["count"] // MOST_INTERVALS))
        some = distinct.where(F.size("v") == r["d"]).orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("v").toArrow()
        axes[r["d"]] = principal(_unit(np.array(some.column(0).to_pylist(), dtype=float)))
    shared = spark.sparkContext.broadcast(axes)

    def cells(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            groups: dict[int, list[int]] = {}
            raw = b.column(1).to_pylist()
            for i, v in enumerate(raw):
                groups.setdefault(len(v), []).append(i)
            for d, at in groups.items():
                x = np.array([raw[i] for i in at], dtype=kind)
                cell = np.floor(_unit(x) @ shared.value[d][:, :LEADING] / eps).astype(np.int64)
                key = [",".join(f"{c + 100000:06d}" for c in row) for row in cell]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array(key), b.column(0).take(take), b.column(2).take(take), pa.array([r.tobytes() for r in x], pa.binary())], ["d", "cell", "rep", "k", "x"])

    ordered = distinct.select("rep", "v", "k").mapInArrow(cells, "d int, cell string, rep long, k long, x binary")
    placed = global_rank(materialize(ordered, "cells"), ["d"], ["cell", "rep", "x"], "at")
    size = F.lit(1).cast("long")
    for d, k in sizes.items():
        size = F.when(F.col("d") == d, k).otherwise(size)
    placed = placed.withColumn("s", F.floor(F.col("at") / size))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        d = int(pdf["d"].iloc[0])
        x = np.frombuffer(b"".join(pdf["x"]), kind).reshape(len(pdf), d)
        p = reduced(_unit(x), shared.value[d])
        return pd.DataFrame({"d": [d], "s": pdf["s"].iloc[:1].to_numpy(), "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "ks": [pdf["k"].to_numpy(np.int64).tobytes()], "xs": [x.tobytes()], "low": [p.min(axis=0)], "high": [p.max(axis=0)]})

    blocks = materialize(placed.groupBy("d", "s").applyInPandas(gather, "d int, s long, ids binary, ks binary, xs binary, low array<double>, high array<double>"), "intervals")
    boxes: dict[int, list] = {}
    for r in blocks.select("d", "s", "low", "high").orderBy("d", "s").collect():  # at most MOST_INTERVALS and one more for each d
        boxes.setdefault(r["d"], []).append((r["low"], r["high"]))
    trees = spark.sparkContext.broadcast({d: Intervals(np.array([x[0] for x in b]), np.array([x[1] for x in b])) for d, b in boxes.items()})

    def pairs(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                near = trees.value[d].near(s, eps)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(near), pa.int32()), pa.array([s] * len(near), pa.int64()), pa.array(near, pa.int64())], ["d", "s", "s2"])

    near = blocks.select("d", "s").mapInArrow(pairs, "d int, s long, s2 long")
    other = blocks.select("d", F.col("s").alias("s2"), *[F.col(c).alias(f"{c}2") for c in ("ids", "ks", "xs")])
    met = near.join(blocks.select("d", "s", "ids", "ks", "xs"), ["d", "s"]).join(other, ["d", "s2"]).select("d", "s", "s2", "ids", "ks", "xs", "ids2", "ks2", "xs2")

    def compare(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            for n in range(b.num_rows):
                d, s, s2, ids, ks, xs, ids2, ks2, xs2 = (c[n].as_py() for c in b.columns)
                a, c = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64)
                ka, kb = np.frombuffer(ks, np.int64), np.frombuffer(ks2, np.int64)
                xa = _unit(np.frombuffer(xs, kind).reshape(-1, d))
                xb = xa if s == s2 else _unit(np.frombuffer(xs2, kind).reshape(-1, d))
                axes = shared.value[d]
                da, db, u, v, _ = join_blocks(xa, ka, reduced(xa, axes), xb, kb, reduced(xb, axes), s == s2, cosine, eps)
                ia, ib = np.flatnonzero(da), np.flatnonzero(db)
                names = np.r_[a, c]
                m = len(ia) + len(ib)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[a[ia], c[ib], names[u]], pa.int64()), pa.array(np.r_[da[ia], db[ib], np.zeros(len(u), np.int64)], pa.int64()), pa.array(np.r_[np.zeros(m, np.int64), names[v]], pa.int64(), mask=np.r_[np.ones(m, bool), np.zeros(len(v), bool)])], ["u", "n", "v"])

    found = materialize(met.mapInArrow(compare, "u long, n long, v long"), "found")
    degree = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    label = components(found.where("v is not null").select("u", "v"))
    known = distinct.join(degree, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("v", "k", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = join_groups(good, materialize(known, "known"), "v", "k", n_rows).select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
