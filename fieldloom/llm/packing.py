"""Packing by optimal length buckets.

A dynamic programme over the global length histogram chooses the bucket boundaries that minimise padding. Inside a
bucket every sequence is padded to the boundary, and as many go to a batch as the token budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldloom.llm.shared import staged

def n_tokens(text: Column) -> Column:
    """Words of a text, split at white space; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending boundaries, at most ``buckets``, the last one the greatest length, with the least padding.

    With N(i) rows among the first i lengths, the padded size of the first j + 1 lengths is the least
    ``best(i) + length(j) * (N(j + 1) - N(i + 1))`` over the last boundary i below j: lines of falling slopes -N(i + 1)
    asked at rising lengths, so a convex hull gives each layer of the programme in linear time. Integers throughout.
    """
    m = len(lengths)
    if not m:
        return []
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    best = [lengths[j] * upto[j + 1] for j in range(m)]  # the first j + 1 lengths in one bucket
    back = []
    for _ in range(min(buckets, m) - 1):
        new, came = list(best), [-1] * m
        hull: list[int] = []  # boundaries whose lines are least somewhere
        at = 0
        for j in range(1, m):
            i = j - 1
            while len(hull) > 1:
                p, q = hull[-2], hull[-1]
                # q is nowhere least if line i is below p before q is
                if (best[i] - best[p]) * (upto[q + 1] - upto[p + 1]) <= (best[q] - best[p]) * (upto[i + 1] - upto[p + 1]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            at = min(at, len(hull) - 1)
            x = lengths[j]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * upto[hull[at + 1] + 1] <= best[hull[at]] - x * upto[hull[at] + 1]:
                at += 1
            i = hull[at]
            cost = best[i] + x * (upto[j + 1] - upto[i + 1])
            if cost < new[j]:
                new[j], came[j] = cost, i
        back.append(came)
        best = new
    cut, j = [lengths[m - 1]], m - 1
    for came in reversed(back):
        if came[j] >= 0:
            j = came[j]
            cut.append(lengths[j])
    return sorted(cut)


def pack(df: DataFrame, buckets: int = 16, budget: int = 32_768, key: str = "doc_id", text: str = "text", chunk_rows: int = 5_000) -> DataFrame:
    """``key``, n_tokens, bucket, bucket_tokens (padded length), batch (gapless inside the bucket), slot (in the batch).

    Every row is packed, those without a token too (padded length at least 1). A sequence longer than the budget is a
    batch of its own. Rows of a bucket are numbered in up to 4096 hashed chunks whose counts are summed, so no task
    holds a bucket. Keys may be null or repeated. Other columns play no part; an empty table gives no rows. The lengths are
    written to the shared folder when the plan is built.
    """
    rows = staged(df.select(F.col(key).alias("_key"), n_tokens(F.col(text)).alias("n"), F.xxhash64(F.col(key), F.col(text)).alias("_h")), "lengths")
    hist = rows.groupBy("n").count().sort("n").toArrow()  # the different lengths: at most the root of twice all words
    spots, counts = hist["n"].to_pylist(), hist["count"].to_pylist()
    total, cuts = sum(counts), boundaries(spots, counts, buckets)
    if not cuts:
        cuts = [0]
    chunks = max(1, min(4096, total // chunk_rows))
    bucket = F.lit(len(cuts) - 1)
    length = F.lit(max(1, cuts[-1]))
    for i in range(len(cuts) - 2, -1, -1):
        bucket, length = F.when(F.col("n") <= cuts[i], i).otherwise(bucket), F.when(F.col("n") <= cuts[i], max(1, cuts[i])).otherwise(length)
    rows = rows.select("*", bucket.alias("bucket"), length.cast("long").alias("bucket_tokens"), F.pmod("_h", F.lit(chunks)).alias("_chunk"))
    order = Window.partitionBy("bucket").orderBy("_chunk")
    before = rows.groupBy("bucket", "_chunk").count().select("bucket", "_chunk", (F.sum("count").over(order) - F.col("count")).alias("_base"))
    inside = Window.partitionBy("bucket", "_chunk").orderBy("_h", "_key")
    placed = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(before), ["bucket", "_chunk"])  # 4096 x buckets rows at most
    at, per = F.col("_base") + F.col("_rank"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return placed.select(F.col("_key").alias(key), F.col("n").alias("n_tokens"), "bucket", "bucket_tokens", F.floor(at / per).alias("batch"), (at % per).cast("int").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document; see ``pack`` for columns and odd rows."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
