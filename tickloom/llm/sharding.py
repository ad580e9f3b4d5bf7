"""Minimax contiguous sharding of atomic groups, with DataFrame functions alone."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, global_rank, join_groups, materialize

CELLS = 32768


class _Ends:
    """Group ends known to the driver (a bounded index), and which gaps hold unknown ones."""

    def __init__(self, total: int):
        self.ends, self.open = [0, total], {0: True}

    def put(self, rows: list[tuple[int, int]]) -> None:
        """rows: (last end, number of ends) of cells, in order.  A cell with one end hides none."""
        known = set(self.ends)
        hidden = {}
        for end, n in rows:
            known.add(end)
            hidden[end] = n > 1
        self.ends = sorted(known)
        self.open = {a: hidden.get(b, self.open.get(a, False)) for a, b in zip(self.ends, self.ends[1:], strict=False)}

    def below(self, limit: int, hopeful: bool) -> int:
        """A bound on the largest group end <= limit: from below, or from above if hopeful."""
        i = bisect_right(self.ends, limit) - 1
        at = self.ends[i]
        return limit if hopeful and self.open.get(at, False) and at < limit else at

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.below(at + capacity, hopeful)
            out.append(at)
        return out


def _least(ok, low: int, high: int) -> int:
    """Smallest value in (low, high] that is ok; high is."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards, none over ``capacity``, whose smallest is as large as can be with cuts at
    ``ends`` (0 first, then ascending).  Up to ``shards`` groups get a shard each.

    The floor is binary-searched: which ends the first k shards can reach follows from those that
    k - 1 can by counting over a window of sizes.  Cuts are then chosen from the last to the first:
    each shard is as close as can be to its share of what is left (the lower cut of two), where groups
    larger than an even shard, and a shard for each, do not count."""
    at = np.array(ends, dtype=np.int64)
    total = int(at[-1])
    if len(at) - 1 <= shards:
        return [*ends[1:], *[total] * (shards - len(at) + 1)]
    high = np.searchsorted(at, at - capacity)  # the first end that one shard before each end may start at

    def reached(floor: int) -> list[np.ndarray]:
        stop = np.searchsorted(at, at - floor, side="right")
        rows = [at == 0]
        for _ in range(shards):
            seen = np.r_[0, np.cumsum(rows[-1])]
            rows.append(seen[np.maximum(stop, high)] > seen[high])
        return rows

    low, top = 1, total // shards + 1
    while top - low > 1:
        mid = (low + top) // 2
        low, top = (mid, top) if reached(mid)[-1][-1] else (low, mid)
    rows, out = reached(low), [total]
    gap = np.diff(at, prepend=0)
    huge = gap > total // shards
    huge_bytes, huge_count = np.cumsum(gap * huge), np.cumsum(huge)
    for k in range(shards - 1, 0, -1):
        end = out[-1]
        i = np.searchsorted(at, end)
        left, parts = end - huge_bytes[i], max(1, k + 1 - huge_count[i])
        fits = at[rows[k] & (at <= end - low) & (at >= end - capacity)]
        out.append(int(fits[np.argmin(np.abs((end - fits) * parts - left))]))
    return out[::-1]


def minimax_cuts(prefix: DataFrame, total: int, largest: int, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """(capacity, ends of the shards): the least capacity with which greedy filling of the ordered
    groups needs at most ``shards`` shards, and cuts that keep to it.

    Greedy filling itself would leave the last shards small, or empty beside one huge group; so the cuts are
    those of even_cuts() over the known ends, of which each 1/``cells`` of all bytes has one if any.

    prefix has (before, size), one row per group.  The driver holds at most a few times ``cells``
    group ends: each round it binary-searches the capacity twice, with every unknown end assumed
    absent (surely feasible) and present (surely infeasible below), and asks for the ends inside
    the windows where the two disagree, ``cells`` at a time.  It stops when both agree, so the
    capacity is exact.
    """
    end = F.col("before") + F.col("size")
    floor = max(largest, -(-total // shards)) - 1
    known, windows = _Ends(total), [(0, total)]
    while True:
        span = sum(b - a for a, b in windows)
        width = max(1, -(-span // cells))
        inside = None
        for a, b in windows:
            one = (end > a) & (end <= b)
            inside = one if inside is None else inside | one
        cell = F.floor((end - 1) / F.lit(width)) if width > 1 else end
        rows = prefix.where(inside).groupBy(cell.alias("c")).agg(F.max(end).alias("e"), F.count("*").alias("n")).orderBy("e").collect()
        known.put([(r["e"], r["n"]) for r in rows])
        sure = _least(lambda c: known.cuts(c, shards, False)[-1] >= total, floor, total)
        maybe = _least(lambda c: known.cuts(c, shards, True)[-1] >= total, floor, total)
        if sure == maybe:
            return sure, even_cuts(known.ends, sure, shards)
        low, high = known.cuts(maybe, shards, False), known.cuts(sure, shards, True)
        windows = _merged([_cell(known, a, b) for a, b in zip(low, high, strict=True)])


def _cell(known: _Ends, a: int, b: int) -> tuple[int, int]:
    ends = known.ends
    i, j = bisect_right(ends, a) - 1, bisect_right(ends, b)
    return ends[max(i, 0)], ends[min(j, len(ends) - 1)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for x in spans if x[0] < x[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity) for every row of docs.

    Size is the text's UTF-8 bytes plus ``overhead``.  Rows with equal texts form one atomic group;
    groups stand in the order of their smallest id.  Shards are runs of groups whose largest total
    is the least possible, and then the smallest total as large as can be (law ``bytes``): a group of
    a third of all rows has a shard of its own and the others share the rest evenly.  Slots count a
    shard's rows from 0 in id order.

    Null text has no bytes and groups with the empty text; its crc32 is 0.  Repeated ids are rows
    of their own.  A null id sorts first.  With fewer groups than shards the last shards are empty.
    An empty table gives no rows.  Other columns are not read.

    A group's total is a partial aggregate and large groups are broadcast back to their rows, so a
    third of all rows may have the same text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), (bytes_of(F.col(text_col)) + overhead).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "sized")
    groups = base.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(-(2**63)).cast("long")).alias("gid"), F.sum("size").alias("size"), F.count("*").alias("n"))
    prefix = materialize(global_rank(materialize(groups, "groups"), [], ["gid", "digest"], "before", weight="size"), "prefix")
    total, largest, rows = prefix.agg(F.sum("size"), F.max("size"), F.sum("n")).first()
    if total is None:
        capacity, cuts = 0, []
    else:
        capacity, cuts = minimax_cuts(prefix, total, largest, shards)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + F.when(F.col("before") >= c, 1).otherwise(0)
    placed = join_groups(base, prefix.select("digest", "before", "n"), "digest", "n", rows or 0).select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"))
    ranked = global_rank(materialize(placed, "placed"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
