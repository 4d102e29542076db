"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame and SQL functions only).

The ring is the range of ``xxhash64`` cut into ``2**cell_bits`` equal cells. Each shard owns ``vnodes`` points on the
ring, each rounded to a cell; a key belongs to the first point at or after its cell. A shard takes at most its capacity;
keys beyond it continue clockwise to the next shard that has room.

Only the number of rows of each cell reaches the driver (at most ``2**cell_bits`` numbers, whatever the table's size).
There the overflow is worked out on counts, which yields for each cell the stretches of ranks that go to a shard, and
the slot of each stretch's first row. The rows themselves are only ranked inside their cell and looked up, so no task
sees more than the rows of its cells.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def ring_owners(shards: int, vnodes: int, cell_bits: int) -> list[list[int]]:
    """For each cell the shards in clockwise order, the owner first. A cell that several points fall into goes to the
    lowest hash among them, so adding a shard never changes the order among the others."""
    cells = 1 << cell_bits
    points: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest(), "big")
            c = h >> (64 - cell_bits)
            points[c] = min(points.get(c, (h, s)), (h, s))
    at = sorted(points)
    orders: dict[int, list[int]] = {}
    for i, c in enumerate(at):
        seen: dict[int, None] = {}
        for j in range(len(at)):
            seen.setdefault(points[at[(i + j) % len(at)]][1])
            if len(seen) == shards:
                break
        orders[c] = [*seen, *(s for s in range(shards) if s not in seen)]
    out, follow = [[]] * cells, orders[at[0]]
    for c in range(cells - 1, -1, -1):
        follow = orders.get(c, follow)
        out[c] = follow
    return out


def spill_plan(counts: dict[int, int], owners: list[list[int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for rows counted by cell.

    In round r every cell offers what is left of it to the r-th shard clockwise; a shard takes offers in cell order
    until it is full. The capacities sum to the number of rows at least, so all rows have a place after the last round.
    """
    room, taken = [*capacity], [0] * len(capacity)
    left = {c: (0, n) for c, n in sorted(counts.items()) if n}
    plan = []
    for r in range(len(capacity)):
        rest = {}
        for c, (lo, n) in left.items():
            s = owners[c][r]
            k = min(n, room[s])
            if k:
                plan.append((c, lo, lo + k, s, taken[s]))
                room[s] -= k
                taken[s] += k
            if k < n:
                rest[c] = (lo + k, n - k)
        left = rest
    if left:
        raise ValueError("the capacities are smaller than the number of rows")
    return plan


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """With epsilon 0 the loads are at most one apart; else each shard may take (1 + epsilon) times the mean."""
    if epsilon > 0:
        return [-(-int(rows * (1 + epsilon) + shards) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The plan as rows, through a SQL literal in chunks (no RDD)."""
    kind = "array<struct<c:bigint,lo:bigint,hi:bigint,s:int,b:bigint>>"
    chunks = [plan[i : i + 4096] for i in range(0, len(plan), 4096)] or [[]]
    texts = [json.dumps([dict(zip("c lo hi s b".split(), p, strict=True)) for p in x], separators=(",", ":")) for x in chunks]
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("j"))
    return rows.select(F.inline(F.from_json("j", kind))).select(
        F.col("c").alias("_cell"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("s").alias("_shard"), F.col("b").alias("_base")
    )


def ring_cell(key: Column, cell_bits: int) -> Column:
    return F.expr("0L") + F.shiftrightunsigned(F.xxhash64(key), 64 - cell_bits)


def shard_documents(df: DataFrame, shards: int = 16, vnodes: int = 64, epsilon: float = 0.05, cell_bits: int = 14, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, size (UTF-8 bytes + 1), text_crc32, shard, slot.

    The home of a row depends on its key alone. A null key hashes like a value of its own, a null text counts as empty,
    rows that are equal in all three columns are interchangeable, and an empty table gives an empty result. Columns
    other than key and text play no part, whatever their names.
    """
    spark = df.sparkSession
    owners = ring_owners(shards, vnodes, cell_bits)
    counts = {r["c"]: r["n"] for r in df.groupBy(ring_cell(F.col(key), cell_bits).alias("c")).agg(F.count("*").alias("n")).collect()}
    plan = spill_plan(counts, owners, capacities(sum(counts.values()), shards, epsilon))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        ring_cell(F.col(key), cell_bits).alias("_cell"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    order = Window.partitionBy("_cell").orderBy(F.xxhash64("_key"), F.col("_key"), "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    at = (F.col("r._cell") == F.col("p._cell")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.alias("r").join(_table(spark, plan).alias("p"), at)
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", F.col("_shard").alias("shard"), (F.col("_base") + F.col("_rank") - F.col("_lo")).cast("long").alias("slot"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: sixteen shards of equal capacity, so counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_documents(docs, shards=16, epsilon=0.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
