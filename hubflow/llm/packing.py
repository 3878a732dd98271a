"""Packing into optimal length buckets and token-budget batches.

1. The global histogram of lengths is aggregated by Spark. Lengths up to
   ``EXACT`` keep their value; longer ones round up by less than 1/2048, so
   the histogram has at most about EXACT + 2048 * 52 entries at any size.
2. Dynamic programming over the histogram picks at most ``n_buckets`` upper
   bounds that minimise the total padding (convex hull trick: one pass over
   the histogram per bucket, exact integers).
3. Inside each bucket, documents in the order of the MD5 of their id fill
   batches of floor(budget / bound) rows (one, where the bound alone exceeds
   the budget). Positions come from counts per (bucket, MD5 prefix) and row
   numbers inside each prefix; the prefix grows with the row count, so no
   task holds a whole bucket, and the result does not depend on its length.

Defined results: null and empty texts have length 0 and are padded to their
bucket like others; rows with equal ids are packed once each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import cut_lineage

N_BUCKETS = 16
TOKEN_BUDGET = 65_536
EXACT = 4096
ROWS_PER_BLOCK = 2048


def word_count(text: Column) -> Column:
    """Words between ASCII white space; pass a tokenizer's count instead where
    exact model tokens are wanted."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_bin(n: Column) -> Column:
    """``n`` itself up to EXACT, above it the next multiple of a step that
    keeps 2048 to 4096 bins per doubling; at least 1."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.greatest(F.length(F.bin(n)) - 12, F.lit(0)))
    return F.greatest(F.when(n <= EXACT, n).otherwise(F.ceil(n / step) * step), F.lit(1)).cast("long")


def optimal_bounds(hist: list[tuple[int, int]], n_buckets: int) -> list[int]:
    """Upper bounds (ascending) that minimise sum(bound * count) over ``hist``
    = (length, count) pairs, with at most ``n_buckets`` buckets."""
    hist = sorted(hist)
    if not hist:
        return []
    lengths = [x for x, _ in hist]
    cum = [0]
    for _, c in hist:
        cum.append(cum[-1] + c)
    m = len(lengths)
    best = [0] + [None] * m           # cost of the first j lengths with k buckets
    choice: list[list[int]] = []
    for _ in range(min(n_buckets, m)):
        # cost_k[j] = length[j-1] * cum[j] + min over i<j of best[i] - length[j-1] * cum[i]
        hull: deque[tuple[int, int, int]] = deque()   # (slope, intercept, i), slopes falling
        now, pick = [0] + [None] * m, [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-cum[i], best[i], i)
                while len(hull) > 1:
                    (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (s1 - s2) <= (b2 - b1) * (s1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                now[j] = x * cum[j] + hull[0][0] * x + hull[0][1]
                pick[j] = hull[0][2]
        if best[m] is not None and now[m] >= best[m]:
            break
        best = now
        choice.append(pick)
    bounds, j = [], m
    for pick in reversed(choice):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = pick[j]
    return sorted(bounds)


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None,
         n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per document: id, n_tokens, bucket, bucket_len, batch (number
    inside the bucket), slot (place inside the batch), padding."""
    length = word_count(F.col("text")) if length is None else length
    rows = cut_lineage(docs.select(F.col(id_col), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
                       .withColumn("_bin", length_bin(F.col("n_tokens")))
                       .withColumn("_md5", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    hist = [(r["_bin"], r["n"]) for r in rows.groupBy("_bin").agg(F.count("*").alias("n")).collect()]
    bounds = optimal_bounds(hist, n_buckets)
    total, digits = sum(c for _, c in hist), 0
    while 16 ** digits * ROWS_PER_BLOCK * max(1, len(bounds)) < total:
        digits += 1
    digits = max(digits, 1)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    placed = (rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("_bin"))))
              .withColumn("bucket_len", F.get(edges, F.col("bucket")))
              .withColumn("_p", F.substring("_md5", 1, digits)))
    counts = placed.groupBy("bucket", "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_p").orderBy("_md5", id_col, "n_tokens")
    ranked = (placed.withColumn("_r", F.row_number().over(inside))
              .join(offsets, ["bucket", "_p"])
              .withColumn("_at", F.col("_before") + F.col("_r") - 1)
              .withColumn("_cap", F.expr(f"greatest(1L, {int(token_budget)}L div bucket_len)")))
    return ranked.select(
        id_col, "n_tokens", "bucket", "bucket_len", F.expr("_at div _cap").alias("batch"),
        (F.col("_at") % F.col("_cap")).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
