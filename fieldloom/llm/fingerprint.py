"""Canonical exact digests of documents (DataFrame and SQL functions only).

A text is brought to one canonical form: Unicode NFKC, full case folding, and every run of white space as one space
with none at the ends. Two differently seeded 64-bit xxhashes of that form make a 128-bit digest. Rows whose digests
agree are then compared byte for byte: a bucket that holds different canonical forms gives each but the first of them
a suffix, so equal fingerprints mean equal canonical texts among the documents, not merely equal hashes.

NFKC and case folding come from the ICU classes that Spark ships, called by ``reflect``; texts that are plain ASCII
need only ``lower``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldloom.llm.shared import staged

#: White space by Unicode's White_Space property, beyond what NFKC already turns into a plain space.
_SPACES = "[\\x09-\\x0d\\x1c-\\x20\\x85\\u1680\\u2028\\u2029]+"


def canonical(text: Column) -> Column:
    """Canonical form of a non-null text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(again), _SPACES, " "))


def digest(canon: Column, bits: int = 128) -> Column:
    """Hex of two differently seeded xxhash64 values. Fewer bits are for tests that need collisions."""
    if bits == 128:
        return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon))))
    return F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(canon), 64 - bits)))


def _ranges(df: DataFrame, key: str, tie: Column, bucket_rows: int, most: int = 4096) -> Column:
    """Number of the key range of a row; ranges follow each other by key, null keys lie in ranges below 0."""
    buckets = max(1, min(most, df.count() // bucket_rows))
    cuts: list = []
    if buckets > 1:
        shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
        cuts = sorted(set(df.select(F.percentile_approx(key, shares, max(10000, 4 * buckets)).alias("q")).first()["q"] or []))
    number = F.lit(0)
    if cuts:  # binary search: how many cuts lie below the key
        table, steps = F.lit(cuts), F.array(*(F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)))
        number = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(cuts)) & (F.try_element_at(table, lo + step) < F.col(key)), lo + step).otherwise(lo))
    return F.when(F.col(key).isNull(), (-1 - F.pmod(tie, F.lit(256))).cast("int")).otherwise(number)


def with_next(df: DataFrame, key: str, carried: list[str], tie: str, bucket_rows: int = 2000) -> DataFrame:
    """Adds ``next_<c>`` for the carried columns: those of the next row by descending key, after the last the first.

    Keys are cut into at most 4096 ranges at approximate quantiles (plus 256 for null keys, which come last). A row
    looks ahead inside its range; the last row of a range takes the head of the next range that has rows. Rows with
    equal keys follow each other by ``tie``, a bigint column.
    """
    held = df.withColumn("_range", _ranges(df, key, F.col(tie), bucket_rows))
    inside = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), F.col(tie))
    ahead = held.select("*", *(F.lead(c).over(inside).alias(f"next_{c}") for c in carried), F.lead(F.lit(True)).over(inside).alias("_more"))
    tops = held.groupBy("_range").agg(F.max(F.struct(F.col(key).alias("k"), (-F.col(tie)).alias("t"))).alias("top"))
    # At most 4352 rows of three numbers: bounded, whatever the table's size.
    tops = tops.select(F.col("_range").alias("_r"), F.col("top.k").alias("_k"), (-F.col("top.t")).alias("_t"))
    heads = held.join(F.broadcast(tops), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col(tie) == F.col("_t")))
    heads = heads.dropDuplicates(["_range"]).select("_range", *(F.col(c).alias(f"_head_{c}") for c in carried))
    along = Window.orderBy(F.col("_range").desc())
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_range", *(F.coalesce(F.lead(f"_head_{c}").over(along), F.first(f"_head_{c}").over(whole)).alias(f"_head_{c}") for c in carried))
    joined = ahead.alias("a").join(after.hint("merge").alias("h"), (F.col("a._range") == F.col("h._range")) & F.col("a._more").isNull(), "left")
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), *(F.when(F.col("a._more"), F.col(f"a.next_{c}")).otherwise(F.col(f"h._head_{c}")).alias(f"next_{c}") for c in carried))


def canonical_groups(df: DataFrame, text: str = "text", bits: int = 128, broadcast_rows: int = 100_000) -> DataFrame:
    """(h, form, suffix) for digests shared by rows of *different* canonical bytes; nearly always no rows.

    Only digests that occur more than once are compared. Rows are gathered by (digest, canonical bytes) with partial
    aggregation, so a group of copies moves once per task, and never into one place.
    """
    canon = df.select(canonical(F.coalesce(F.col(text), F.lit(""))).alias("form")).withColumn("h", digest(F.col("form"), bits))
    repeated = staged(canon.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "digests")
    side = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    forms = canon.join(side, "h", "left_semi").groupBy("h", "form").agg(F.count("*").alias("n"))
    clashes = forms.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    first = Window.partitionBy("h").orderBy("form")
    ranked = forms.join(clashes, "h", "left_semi").withColumn("at", F.row_number().over(first) - 1)
    return ranked.select("h", "form", F.when(F.col("at") > 0, F.concat(F.lit("-"), F.col("at").cast("string"))).otherwise("").alias("suffix"))


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128, bucket_rows: int = 2000) -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    A null text counts as empty. The edited text of a document replaces its last third by the beginning of the next
    document (descending key). Likeness is 1 where canonical bytes are equal, else 0. The only row of a table is its
    own next one; an empty table gives no rows; other columns play no part.
    """
    rows = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text")).withColumn("_h", digest(canonical(F.col("_text")), bits))
    near = with_next(rows, "_id", ["_text", "_h"], "_tie", bucket_rows).withColumn("n", F.char_length("_text"))
    third = F.floor(F.col("n") / 3).cast("int")
    near = near.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.col("n") - third), F.substring("next__text", F.lit(1), third)))
    near = near.withColumn("_e", digest(canonical(F.col("_edited")), bits))
    same = lambda a, b, at, bt: F.when(F.col(a) == F.col(b), canonical(F.col(at)) == canonical(F.col(bt))).otherwise(F.lit(False))  # noqa: E731  bytes settle it
    near = near.select(
        "_id", "_tie", "_h", "_e", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        same("_h", "_e", "_text", "_edited").alias("_ne"), same("_h", "next__h", "_text", "next__text").alias("_nn"),
    )
    clashes = staged(canonical_groups(df, text, bits), "clashes")
    if clashes.isEmpty():
        near = near.withColumn("_f", F.col("_h"))
    else:
        held = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().select(F.xxhash64("t").alias("_tie"), canonical(F.col("t")).alias("form"))
        held = held.withColumn("h", digest(F.col("form"), bits)).join(clashes, ["h", "form"]).select(F.col("h").alias("_h"), "_tie", "suffix").distinct()
        near = near.join(held, ["_h", "_tie"], "left").withColumn("_f", F.concat("_h", F.coalesce("suffix", F.lit(""))))
    edited = F.when(F.col("_ne"), F.col("_f")).when(F.col("_e") == F.col("_h"), F.concat("_e", F.lit("-e"))).otherwise(F.col("_e"))
    return near.select(F.col("_id").alias(key), "n_chars", "edited_sha256", F.col("_f").alias("fingerprint"), edited.alias("edited_fingerprint"), F.col("_ne").cast("double").alias("near_edited"), F.col("_nn").cast("double").alias("near_next"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text; see ``fingerprint_documents`` for columns and odd rows."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
