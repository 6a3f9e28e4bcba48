"""Packing by optimal length buckets: dynamic programming over the global histogram of lengths, then token-budget batches.

The histogram has a row for each different length, and k different lengths take k (k + 1) / 2 tokens at least, so that it
grows with the square root of the corpus at most. The boundaries that minimise the total padding for BUCKETS buckets are
found exactly on it. In each bucket documents fill batches of BUDGET padded tokens in a seeded order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import running_before, seeded, table, text_of, words_of, written

BUCKETS, BUDGET, SEED = 16, 16_384, "pack"


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least sum of counts times (upper - length); lengths ascend.

    The best beginning of the last bucket never falls as its end grows, so each round settles the ends halfway between
    those settled before, between their beginnings: about n log n sums a bucket.
    """
    x, c = np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.float64)
    n = len(x)
    if not n:
        return []
    c0, w0 = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        after, chosen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        after[0] = 0
        step = 1 << n.bit_length()
        while step:
            j = np.arange(step, n + 1, 2 * step)
            if len(j):
                # The last bucket holds lengths i..j-1; i lies between the beginnings of the ends on either side.
                low = np.where(j - step > 0, chosen[j - step], 0)
                high = np.minimum(np.where(j + step <= n, chosen[np.minimum(j + step, n)], n), j - 1)
                size = np.maximum(high - low, 0) + 1
                first = np.cumsum(size) - size
                i = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(low, size)
                end = np.repeat(j, size)
                total = best[i] + x[end - 1] * (c0[end] - c0[i]) - (w0[end] - w0[i])
                least = np.minimum.reduceat(total, first)
                hit = np.where(total == np.repeat(least, size), i, n)
                after[j], chosen[j] = least, np.minimum.reduceat(hit, first)
            step >>= 1
        choices.append(chosen)
        best = after
    out, j = [], n
    for chosen in reversed(choices):
        if j > 0:
            out.append(lengths[j - 1])
            j = int(chosen[j])
    return sorted(out)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, place and batch_rows of each row.

    A token is a word. A batch holds budget / bucket_length rows, one at least, so a document longer than the budget is a
    batch of its own and none is cut. Defined results: a null or empty text has no tokens and is packed with the
    shortest; identical rows are packed one by one; null ids come in the order of their texts; an empty table gives an
    empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.size(words_of(text_of(text_col))).cast("long").alias("n_tokens"), F.spark_partition_id().alias("part"))
    # Equal rows of a task become one with their number, so that a document that is there very often doesn't fill a cell.
    d = written(d.groupBy("doc_id", "text_hash", "n_tokens", "part").agg(F.count(F.lit(1)).alias("rows")))
    histogram = sorted(d.groupBy("n_tokens").agg(F.sum("rows").alias("rows")).collect())
    tops = boundaries([r["n_tokens"] for r in histogram], [r["rows"] for r in histogram], buckets) or [0]
    index, top = F.lit(len(tops) - 1), F.lit(tops[-1])
    for i, t in reversed(list(enumerate(tops[:-1]))):
        index, top = F.when(F.col("n_tokens") <= t, i).otherwise(index), F.when(F.col("n_tokens") <= t, t).otherwise(top)
    d = d.withColumns({"bucket": index.cast("int"), "bucket_length": top.cast("long"), "key": seeded(SEED, "doc_id", "text_hash")})
    d = running_before(d, "bucket", "key", "rows", ["doc_id", "text_hash", "part"])
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("before", F.col("before") + F.col("nth"))
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)).cast("long")
    d = d.withColumn("batch_rows", rows)
    return d.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("before") / F.col("batch_rows")).cast("long").alias("batch"), (F.col("before") % F.col("batch_rows")).alias("place"), "batch_rows")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
