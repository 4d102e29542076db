"""Mail-merge record loops as DataFrame transforms.

A loop numbers its records. ``ordered`` does so without one task holding the table: rows are dealt to ranges of the key,
numbered inside, and the ranges' sizes, a bounded table, are summed. As the numbers have no gaps, records that a pass reads
ahead come from blocks of consecutive numbers with a short overlap.

A pass starts at record p; NEXT, NEXTIF and SKIPIF move the record on, by m in all. The next pass starts at p + max(m, 1):
the last record read starts it. Where m depends on the data, the starts are found by following the moves in two passes over
the blocks: what each block makes of every entry, then, with the entries known, which records are starts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.values import Value, of_type
from fieldloom.plans.fields import Context, Evaluator, record_values

ROWS_PER_RANGE = 200_000


def ordered(df: DataFrame, key: str, name: str = "mergerec", rows_per_range: int = ROWS_PER_RANGE, kept: Column | None = None, kept_name: str = "mergeseq") -> DataFrame:
    """Adds the 1-based position by ``key`` (unique; a null one is last), and with ``kept`` the position among the rows it holds for."""
    flags = df if kept is None else df.withColumn("_kept", F.coalesce(kept, F.lit(False)).cast("long"))
    count = flags.count()
    ranges = max(1, min(4096, count // rows_per_range))
    extra = [] if kept is None else [(F.sum("_kept"), "_kept", kept_name)]
    if ranges == 1:
        w = Window.orderBy(F.col(key).asc_nulls_last())
        out = flags.withColumn(name, F.row_number().over(w).cast("long"))
        if extra:
            out = out.withColumn(kept_name, F.sum("_kept").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_kept")
        return out
    cuts = sorted(set(flags.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]))
    bits = range(len(cuts).bit_length() - 1, -1, -1)
    table = F.lit(cuts)
    below = F.aggregate(F.array(*(F.lit(1 << b) for b in bits)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, F.least(at + step, F.lit(len(cuts))) - 1) < F.col(key)), at + step).otherwise(at))
    held = flags.withColumn("_range", F.when(F.col(key).isNull(), len(cuts)).otherwise(below))
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"), *(a.alias(f"_s{i}") for i, (a, _, _) in enumerate(extra)))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"), *(F.coalesce(F.sum(f"_s{i}").over(along), F.lit(0)).alias(f"_base{i}") for i in range(len(extra))))
    inside = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last())
    out = held.withColumn("_at", F.row_number().over(inside))
    for _, source, to in extra:
        out = out.withColumn(f"_at_{to}", F.sum(source).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_base") + F.col("_at"))  # 4096 rows at most
    for i, (_, _, to) in enumerate(extra):
        out = out.withColumn(to, F.col(f"_base{i}") + F.col(f"_at_{to}")).drop(f"_at_{to}")
    return out.drop("_range", "_base", "_at", "_kept", *(f"_base{i}" for i in range(len(extra))))


def merge_records(df: DataFrame, key: str, skip_if: Column | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """MERGEREC counts all records, MERGESEQ those that give an output; SKIPIF drops a record's output."""
    keep = F.lit(True) if skip_if is None else ~F.coalesce(skip_if, F.lit(False))
    out = ordered(df.withColumn("_keep", keep), key, rows_per_range=rows_per_range, kept=F.col("_keep"))
    return out.filter("_keep").drop("_keep")


def ahead(df: DataFrame, columns: list[str], most: int, number: str = "mergerec", rows_per_block: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``_<i>_<column>`` for i from 1 to ``most``: the value ``i`` records further, null behind the last; ``number`` has
    no gaps, so a block needs but the first rows of the one behind it."""
    if not most:
        return df
    block = F.floor((F.col(number) - 1) / rows_per_block)
    early = (F.col(number) - 1) % rows_per_block < most
    spots = F.when(early & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = df.withColumn("_own", block).withColumn("_block", F.explode(spots))
    w = Window.partitionBy("_block").orderBy(number)
    out = dealt.select("*", *(F.lead(c, i).over(w).alias(f"_{i}_{c}") for i in range(1, most + 1) for c in columns))
    return out.filter("_own = _block").drop("_own", "_block")


def starts(df: DataFrame, step: str, number: str = "mergerec", most: int = 1, rows_per_block: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows at which a pass starts: the first, and ``step`` (1 to ``most``) behind each start."""
    if most <= 1:
        return df
    narrow = df.select(F.floor((F.col(number) - 1) / rows_per_block).alias("_block"), ((F.col(number) - 1) % rows_per_block).cast("int").alias("_at"), F.col(step).cast("int").alias("_step"))

    def leaves(pdf: pd.DataFrame) -> np.ndarray:
        """For each position of the block, how far into the next block the passes from there get."""
        steps = pdf.sort_values("_at")["_step"].tolist()
        out = [0] * len(steps)
        for i in range(len(steps) - 1, -1, -1):
            to = i + steps[i]
            out[i] = out[to] if to < len(steps) else to - len(steps)
        return np.array(out)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        got = leaves(pdf)[:most]
        # A block with fewer rows than moves is the last one.
        return pd.DataFrame({"block": int(pdf["_block"].iloc[0]), "entry": range(len(got)), "to": got})

    known = {(r["block"], r["entry"]): r["to"] for r in narrow.groupBy("_block").applyInPandas(exits, "block long, entry int, to int").collect()}  # a few numbers a block
    entries, at = [], 0
    for block in sorted({b for b, _ in known}):
        entries.append((block, at))
        at = known.get((block, at), at)
    spark = df.sparkSession
    entry = spark.createDataFrame(entries or [(0, 0)], "_block long, _entry int")

    def reached(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        steps, at, out = pdf["_step"].tolist(), int(pdf["_entry"].iloc[0]), []
        while at < len(steps):
            out.append(at)
            at += steps[at]
        return pd.DataFrame({"_number": [int(pdf["_block"].iloc[0]) * rows_per_block + i + 1 for i in out]})

    held = narrow.join(F.broadcast(entry), "_block").groupBy("_block").applyInPandas(reached, "_number long")
    return df.join(held.withColumnRenamed("_number", number), number, "left_semi")


def merge(df: DataFrame, template: Mapping[str, str], order_by: str, context: Context | None = None, keep: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per output: the columns of ``keep``, mergerec, mergeseq, and the text of each field of the template, whose
    fields are evaluated in order. Every pass has its own bookmarks and counters. A record that NEXT would read behind the
    last one is empty; the output stays."""
    base, fields = context or Context(), record_values(df)
    probe = Evaluator(replace(base, record=fields))
    for instruction in template.values():
        probe.field(instruction)
    most = probe.moved
    types = dict(df.dtypes)
    # Only rows that a conditional move reads ahead need other records.
    rec = ahead(ordered(df, order_by, rows_per_range=rows_per_range), df.columns, most, rows_per_block=rows_per_range)

    def at(i: Column | int) -> dict[str, Value]:
        if isinstance(i, int):
            return {c: of_type(F.col(f"`{c}`" if not i else f"`_{i}_{c}`"), types[c]) for c in df.columns}
        spread = {c: F.array(*(F.col(f"`{c}`" if not k else f"`_{k}_{c}`") for k in range(most + 1))) for c in df.columns}
        return {c: of_type(F.get(spread[c], i), types[c]) for c in df.columns}

    def compiled(sequence: Column | None) -> tuple[Evaluator, dict[str, Column]]:
        e = Evaluator(replace(base, record=fields, record_number=F.col("mergerec"), sequence_number=sequence), at)
        return e, {k: e.field(v).text for k, v in template.items()}

    e, _ = compiled(F.lit(1))
    if most > 1:
        rec = starts(rec.withColumn("_step", F.greatest(F.lit(e.moves) if isinstance(e.moves, int) else e.moves, F.lit(1)).cast("int")), "_step", most=most, rows_per_block=rows_per_range).drop("_step")
    if e.skipped is not None:
        rec = rec.filter(~e.skipped)
    if most > 1 or e.skipped is not None:
        rec = ordered(rec, "mergerec", "mergeseq", rows_per_range)
    else:
        rec = rec.withColumn("mergeseq", F.col("mergerec"))
    _, shown = compiled(F.col("mergeseq"))
    return rec.select(*keep, "mergerec", "mergeseq", *(v.alias(k) for k, v in shown.items()))


def merge_next(df: DataFrame, key: str, columns: list[str], nexts: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """NEXT: each output reads ``nexts`` more records as ``<column>_<i>``, and the last one read starts the next output."""
    rec = ahead(ordered(df, key, rows_per_range=rows_per_range), columns, nexts, rows_per_block=rows_per_range)
    out = rec.filter((F.col("mergerec") - 1) % nexts == 0)
    return out.select(*df.columns, "mergerec", *(F.col(f"_{i}_{c}").alias(f"{c}_{i}") for i in range(1, nexts + 1) for c in columns))
