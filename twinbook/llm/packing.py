"""Packing texts into batches: optimal length buckets and a token budget.

Dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding. Inside each bucket texts fill batches whose
padded size stays within the token budget.

Edge cases: null, empty and blank texts have length 0 and share the first
bucket, where they count as one token each; a text longer than the budget is a
batch of its own; equal lengths are never split over buckets; repeated rows are
packed each on its own (also if all are alike); an empty table gives an empty
result; other columns pass by untouched, but those named like an output
(n_tokens, bucket, bucket_tokens, batch, slot) are replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbers

BUCKETS, BUDGET = 12, 65536
#: Texts that one task numbers within a bucket.
SHARD = 20_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(squeezed) - F.length(F.regexp_replace(squeezed, "w", ""))


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise sum(count * (upper end - length)).

    ``lengths`` ascend and are distinct. Each layer of the program is solved by
    divide and conquer, as the best split point does not fall when the end rises;
    the halves of one depth are solved together.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    total = np.concatenate([[0], np.cumsum(lengths * counts, dtype=np.float64)])
    cost = lambda i, j: lengths[j - 1] * (size[j] - size[i]) - (total[j] - total[i])
    best = np.concatenate([[0.0], cost(np.zeros(n, int), np.arange(1, n + 1))])
    came = []
    for _ in range(min(buckets, n) - 1):
        now, frm = best.copy(), np.zeros(n + 1, int)
        lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            many = np.minimum(last, mid - 1) - first + 1
            begin = np.cumsum(many) - many
            end = np.repeat(mid, many)
            i = np.arange(many.sum()) + np.repeat(first - begin, many)
            value = best[i] + cost(i, end)
            least = np.minimum.reduceat(value, begin)
            hit = np.flatnonzero(value == np.repeat(least, many))
            k = i[hit[np.searchsorted(hit, begin)]]
            now[mid], frm[mid] = least, k
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, k), (k, last)))
            go = lo <= hi
            lo, hi, first, last = lo[go], hi[go], first[go], last[go]
        came.append(frm)
        best = now
    ends, j = [], n
    for frm in reversed(came):
        ends.append(int(lengths[j - 1]))
        j = int(frm[j])
        if j == 0:
            break
    if j > 0:
        ends.append(int(lengths[j - 1]))
    return ends[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``docs`` with n_tokens, bucket (from 0), bucket_tokens, batch (within the bucket) and slot (within the batch).

    bucket_tokens is the padded length; a batch holds budget // bucket_tokens texts, one at least. ``docs`` is written
    to the shared folder once, so leave out columns that the batches need not carry. The driver gets the histogram of
    the lengths: fewer than the square root of twice the corpus's words.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    made = ("n_tokens", "bucket", "bucket_tokens", "batch", "slot")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    # The row's number in the table that is written here fixes its shard.
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    rows = scratch.keep(rows, "rows")
    histogram = numbers(rows.groupBy("n_tokens").agg(F.count("*").alias("n")))
    levels, counts = histogram[np.argsort(histogram[:, 0])].T
    ends = optimal_boundaries(levels, counts, buckets)
    bucket = F.lit(0)
    for k, end in enumerate(ends[:-1]):
        bucket = F.when(F.col("n_tokens") > end, k + 1).otherwise(bucket)
    shards = max(1, -(-int(counts.sum()) // SHARD))
    # Number the texts of a bucket without gathering them: within shards, then by the shards' counts.
    rows = rows.withColumns({"bucket": bucket, "shard": F.pmod("deal", F.lit(shards))})
    place = F.expr(f"row_number() over (partition by bucket, shard order by n_tokens, row.`{id_col}`, deal)")
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.expr("sum(n) over (partition by bucket order by shard) - n")).drop("n")
    per = {k: (end, max(1, budget // max(1, end))) for k, end in enumerate(ends)} or {0: (0, 1)}
    pick = lambda i: F.element_at(F.array(*(F.lit(per[k][i]).cast("long") for k in sorted(per))), F.col("bucket") + 1)
    out = rows.withColumn("place", place).join(before, ["bucket", "shard"])
    out = out.withColumns({"bucket_tokens": pick(0), "per": pick(1), "at": F.col("before") + F.col("place") - 1})
    return out.withColumns({"batch": F.floor(F.col("at") / F.col("per")), "slot": F.col("at") % F.col("per")}).select("row.*", *made)
