"""Length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries (lengths, ascending) with the least padding over a histogram in order of
    length: longest length, rows and summed length of each entry.  Dynamic programming over entries:
    best[k][j] = least padding of entries up to j in k buckets.

    Where the last bucket begins after entry i, the cost is a line in the length of entry j, with a
    slope that falls with i; so the lower hull of the lines, walked once by a queue, gives all j of a k
    in linear time.  Whole numbers of Python keep every comparison exact."""
    n = len(longest)
    if not n:
        return []
    tall = longest.tolist()
    rows, sums = np.cumsum(count).tolist(), np.cumsum(total).tolist()
    best = [x * r - s for x, r, s in zip(tall, rows, sums, strict=True)]
    back = [np.full(n, -1, dtype=np.int32)]
    for _ in range(1, min(buckets, n)):
        now, come = best.copy(), np.full(n, -1, dtype=np.int32)
        hull, head = [], 0  # (slope, value at 0, i)
        for j in range(1, n):
            m, c = -rows[j - 1], best[j - 1] + sums[j - 1]
            while len(hull) - head > 1:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                    break
                hull.pop()
            hull.append((m, c, j - 1))
            x = tall[j]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            cost = hull[head][0] * x + hull[head][1] + x * rows[j] - sums[j]
            if cost < now[j]:
                now[j], come[j] = cost, hull[head][2]
        back.append(come)
        best = now
    out, j, k = [], n - 1, len(back) - 1
    while True:
        while k and back[k][j] < 0:
            k -= 1
        out.append(int(longest[j]))
        if not k:
            return out[::-1]
        j, k = int(back[k][j]), k - 1


def pack(rows: DataFrame, buckets: int = 16, budget: int = 65536, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, slot, padding) for every row.

    The histogram of all lengths decides at most ``buckets`` boundaries with the least padding.  The
    driver holds one row for each distinct length, at most about sqrt(2 * all tokens) of them.  Within
    a bucket, rows in id order form batches of budget // boundary rows, one at least, so that a padded
    batch stays within the budget unless a single row is over it.  batch numbers count from 0 within a
    bucket.

    A null length counts as 0.  Repeated ids are rows of their own.  No rows give no rows.
    """
    slim = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens"))
    hist = slim.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    length, count = (hist[c].to_numpy() for c in ("n_tokens", "count"))
    edges = best_boundaries(length, count, length * count, buckets)
    bucket, boundary = F.lit(0), F.lit(0).cast("long")
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("n_tokens") <= e, i).otherwise(bucket)
        boundary = F.when(F.col("n_tokens") <= e, e).otherwise(boundary)
    dealt = slim.withColumns({"bucket": bucket.cast("int"), "boundary": boundary.cast("long")})
    ranked = global_rank(dealt, ["bucket"], ["doc_id", "n_tokens"], "_rank")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))))
    return ranked.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("_rank") / room).cast("long").alias("batch"), (F.col("_rank") % room).cast("long").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))
