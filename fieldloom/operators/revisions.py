"""Tracked changes as views of rows: accept, reject, inline marks, split, and a classifier by the look of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_flags(inserted: Column, deleted: Column) -> tuple[Column, Column]:
    """What the accepted and the rejected document keep: an insertion only the first, a deletion only the second."""
    return ~F.coalesce(deleted, F.lit(False)), ~F.coalesce(inserted, F.lit(False))


def within(keep: Column, outer: Column) -> Column:
    """A row inside of another is kept only if both are."""
    return keep & outer


def accepted(df: DataFrame, keep_accept: Column) -> DataFrame:
    return df.filter(keep_accept)


def rejected(df: DataFrame, keep_reject: Column) -> DataFrame:
    return df.filter(keep_reject)


def change(keep_accept: Column, keep_reject: Column) -> Column:
    """Unchanged, Inserted or Deleted; what neither document keeps is null."""
    return F.when(keep_accept & keep_reject, "Unchanged").when(keep_accept, "Inserted").when(keep_reject, "Deleted")


#: Tags of the inline view.
TAGS = {"Inserted": ("<ins>", "</ins>"), "Deleted": ("<del>", "</del>")}


def inline(df: DataFrame, doc: list[str], order: str, text: str, keep_accept: Column, keep_reject: Column, name: str = "inline") -> DataFrame:
    """The text of each row with tags where runs of insertions or deletions open and close."""
    w = Window.partitionBy(*doc).orderBy(order)
    out = df.withColumn("_mode", F.coalesce(change(keep_accept, keep_reject), F.lit("Unchanged")))
    out = out.withColumn("_before", F.lag("_mode", 1, "Unchanged").over(w)).withColumn("_behind", F.lead("_mode", 1, "Unchanged").over(w))

    def tag(mode: Column, i: int) -> Column:
        return F.when(mode == "Inserted", TAGS["Inserted"][i]).when(mode == "Deleted", TAGS["Deleted"][i]).otherwise("")

    opened = F.when(F.col("_before") != F.col("_mode"), tag(F.col("_mode"), 0)).otherwise("")
    closed = F.when(F.col("_behind") != F.col("_mode"), tag(F.col("_mode"), 1)).otherwise("")
    return out.withColumn(name, F.concat(opened, F.coalesce(F.col(text).cast("string"), F.lit("")), closed)).drop("_mode", "_before", "_behind")


def split(df: DataFrame, group: list[str], order: str, text: str, keep_accept: Column, keep_reject: Column) -> DataFrame:
    """Both texts of each group: one where they are equal, else both side by side."""
    piece = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), F.col(text).cast("string").alias("t"))))), lambda x: x["t"]), "")
    out = df.groupBy(*group).agg(piece(keep_reject).alias("rejected"), piece(keep_accept).alias("accepted"))
    two = F.concat(F.lit("<table><tr><td>"), "rejected", F.lit("</td><td>"), "accepted", F.lit("</td></tr></table>"))
    return out.withColumn("split", F.when(F.col("rejected") == F.col("accepted"), F.col("accepted")).otherwise(two))


def by_look(underlined: Column, struck: Column) -> Column:
    """Changes told by the look of text: struck is deleted, underlined inserted; struck wins."""
    return F.when(F.coalesce(struck, F.lit(False)), "Deleted").when(F.coalesce(underlined, F.lit(False)), "Inserted").otherwise("Unchanged")


def classified(df: DataFrame, classify: Column, underline: str = "underline", strike: str = "strike") -> DataFrame:
    """Rows with the flags that a classifier's change gives, and without the look that told it."""
    out = df.withColumn("_change", classify).withColumn("keep_accept", F.col("_change") != "Deleted").withColumn("keep_reject", F.col("_change") != "Inserted")
    out = out.withColumn(strike, F.when(F.col("_change") == "Deleted", F.lit(False)).otherwise(F.col(strike)))
    return out.withColumn(underline, F.when(F.col("_change") == "Inserted", F.lit(False)).otherwise(F.col(underline))).drop("_change")
