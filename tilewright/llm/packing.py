"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries
with the least padding; inside each bucket, batches of equal shape fill a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import scratch

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows of a bucket that are numbered together.
CELL = 20_000
#: Splits times ends that the search for boundaries looks at in one go.
DENSE = 4096


def n_tokens(text_col: str = "text"):
    """White-space words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most k bucket boundaries, the largest length among them, with the least total padding.

    cost(i, j) = lengths[j] * rows in i..j - tokens in i..j. With one bucket more, the best split moves to the right
    as j does (the cost satisfies the quadrangle inequality), so each layer is found by divide and conquer. Of equal
    paddings the one with the earliest splits is taken."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n = len(x)
    if n == 0:
        return []
    rows, tokens = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * x)])
    k = min(k, n)
    best = x * rows[1:] - tokens[1:]
    whole = best
    splits = []
    for _ in range(1, k):
        after, where = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            # The last bucket is i+1..j; i = -1 leaves the layer's bucket unused. A small block is looked at at once.
            i = np.arange(a, b + 1)
            small = (hi - lo + 1) * len(i) <= DENSE
            j = np.arange(lo, hi + 1) if small else np.array([(lo + hi) // 2])
            cost = best[i] + x[j, None] * (rows[j + 1, None] - rows[i + 1]) - (tokens[j + 1, None] - tokens[i + 1])
            cost[i >= j[:, None]] = np.inf
            m = cost.argmin(axis=1)
            least = cost[np.arange(len(j)), m]
            used = least < whole[j]
            after[j], where[j] = np.where(used, least, whole[j]), np.where(used, i[m], -1)
            if not small:
                mid, at = int(j[0]), int(i[m[0]]) if used[0] else a
                todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        splits.append(where)
        best = after
    out, j = [int(x[n - 1])], n - 1
    for where in reversed(splits):
        j = int(where[j])
        if j < 0:
            break
        out.append(int(x[j]))
    return out[::-1]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row for each row of df: id, n_tokens, bucket (from 0 by length), padded (its boundary, a length that occurs),
    batch (number in the bucket), slot (place in the batch), padding.

    A batch holds max(1, budget // padded) rows, all batches of a bucket but the last as many. Rows are numbered in the
    order of a hash of id and text, so that a rerun gives the same batches; equal rows follow each other in any order.
    Null and empty texts have length 0 and count as 1 for the budget; null ids are ids like others. Nothing is dropped
    or cut: a text over the budget is a batch of its own. Other columns are not read.

    The texts are read once, for their lengths. The driver gets the histogram, one row for each length that occurs;
    n different lengths need n * n / 2 tokens, so that 10 ** 13 tokens have less than 5 million."""
    rows, _ = scratch(df.select(F.col(id_col), n_tokens(text_col).alias("n_tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")), "packing-lengths")
    hist = rows.groupBy("n_tokens").count().toPandas()
    bounds = boundaries(hist["n_tokens"].to_numpy(np.int64), hist["count"].to_numpy(np.int64), buckets) or [0]
    size = np.bincount(np.searchsorted(bounds, hist["n_tokens"]), hist["count"], len(bounds)) if len(hist) else [0]
    of_bucket = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("n_tokens"))))
    rows = rows.withColumn("padded", of_bucket(bounds)).withColumn("_cell", F.pmod(F.col("_h"), of_bucket([max(1, -(-n // CELL)) for n in size])))
    counts = rows.groupBy("bucket", "_cell").count()
    before = counts.select("bucket", "_cell", (F.sum("count").over(Window.partitionBy("bucket").orderBy("_cell")) - F.col("count")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("bucket", "_cell").orderBy("_h", F.col(id_col))) - 1
    placed = rows.withColumn("_n", n).join(before, ["bucket", "_cell"]).withColumn("_n", F.col("_n") + F.col("_before"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1)))).cast("long")
    return placed.select(id_col, "n_tokens", "bucket", "padded", F.floor(F.col("_n") / per).alias("batch"), (F.col("_n") % per).cast("int").alias("slot"), (F.col("padded") - F.col("n_tokens")).alias("padding"))
