"""The corpus pipeline: documents that are toxic or of no learned language go, near copies are reduced to one, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm.langid import identify, learn_samples, usual_bits
from fieldloom.llm.packing import pack
from fieldloom.llm.setjoin import jaccard_join
from fieldloom.llm.shared import free_name, staged, without
from fieldloom.llm.toxicity import labelled, score_documents, train_with_threshold

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its toxicity is TOXIC or more, or less where folds of the labelled documents tell so.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay, repeated rows are judged alike; without labels of both classes, and from an empty table,
    nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (model, least), score = train_with_threshold(labelled(docs, labels), most=TOXIC), free_name(docs, "_toxicity")
    scored = score_documents(docs, model, score=score, found=None)
    return scored.filter(F.col(score) < least).select(*without(scored, score))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go, null and empty ones among them, and so do those far from the
    labelled texts of the language nearest to them. Without labelled texts, and from an empty table, no row is left."""
    lang = free_name(docs, "_told_lang")
    told = identify(docs, learn_samples(docs), lang_column=lang, score_column=free_name(docs, "_told_score"), bounds=usual_bits(docs))
    return told.filter(F.col(lang) != "und").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays (a null one only if there is no other).

    Rows are told apart by a key of their own, as doc_id may be null or repeated. Rows without a word are near to no
    other; of those with the same doc_id and text one stays. An empty table stays empty.
    """
    row = free_name(docs, "_row")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")  # written, so that the keys stay
    groups = jaccard_join(keyed.select(row, "text"), key=row).select(F.col(row).alias("r"), "group_id", (F.col("n_shingles") == 0).alias("bare"))
    rows = keyed.select(F.col(row).alias("r"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    named = rows.join(groups, "r").withColumn("group", F.when(~F.col("bare"), F.col("group_id"))).withColumn("own", F.when(F.col("bare"), F.struct("d", "h", "n")))
    first = named.groupBy("group", "own").agg(F.min(F.struct(F.col("d").isNull().alias("null"), "d", "h", "r")).alias("m"))
    return keyed.join(first.select(F.col("m.r").alias(row)), row, "left_semi").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document; see ``pack`` for columns and odd rows."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("jaccard_join", one_of_each_group), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and similarity groups can't be written in SQL; tests/llm/test_pipeline.py compares run() and the stages with brute force.
ORACLE_SQL = None
