"""The library's front: read, evaluate, merge, render, export."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.functions.text import html_text
from fieldloom.operators import merge as _merge
from fieldloom.plans.fields import Context, evaluate
from fieldloom.render import blocks, html, markdown, text
from fieldloom.render.docx import rebuild_all
from fieldloom.sources import docx

#: Formats by ending of a file's name.
FORMATS = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx"}


def format_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"no format for {path!r}")
    return FORMATS[ending]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc, content) of the packages under a path or glob."""
    return docx.read_packages(spark, path)


def render(paragraphs: DataFrame, format_: str = "text", plain: bool = False, keep: str | None = None) -> DataFrame:
    """(doc, body) of a paragraph table."""
    if format_ == "text":
        return text.document(paragraphs, keep)
    if format_ == "markdown":
        return markdown.document(paragraphs, markdown.PLAIN if plain else markdown.RICH, keep)
    if format_ == "html":
        return html.document(paragraphs, html.PLAIN if plain else html.RICH, keep)
    raise ValueError(f"no renderer for {format_!r}")


def export(packages: DataFrame, format_: str = "text", plain: bool = False, accept: bool = True) -> DataFrame:
    """(doc, body) of packages, with tracked changes accepted or rejected; Word packages are written back as (doc, content)."""
    if format_ == "docx":
        return rebuild_all(packages)
    nodes, styles = docx.scan(packages, "nodes"), docx.scan(packages, "styles")
    keep = "keep_accept" if accept else "keep_reject"
    df = blocks.paragraphs(nodes, styles, accept).filter(F.col(keep))
    if format_ == "text":
        parts = blocks.with_tables(nodes, df, text.paragraph, blocks.ascii_tables)
    elif format_ == "markdown" and plain:
        parts = blocks.with_tables(nodes, df, lambda p: markdown.paragraph(p, markdown.PLAIN), blocks.pipe_tables)
    elif format_ == "markdown":
        parts = blocks.with_tables(nodes, df, markdown.paragraph, lambda t: blocks.html_tables(t, html_text))
    elif format_ == "html":
        options = html.PLAIN if plain else html.RICH
        parts = blocks.with_tables(nodes, df, lambda p: html.paragraph(p, options), lambda t: blocks.html_tables(t, html_text))
        return html.framed(blocks.joined(parts, F.col("shown")), options)
    else:
        raise ValueError(f"no renderer for {format_!r}")
    return blocks.joined(parts, F.col("shown"))


def collect(nodes: DataFrame, visit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a collector makes of the nodes; nothing is rendered."""
    return nodes.transform(visit)


def write_files(outputs: DataFrame, path: str, body: str = "body", name: str = "mergeseq") -> None:
    """One folder of text for each output, named by a column; written by the tasks that have the rows."""
    outputs.select(F.col(body).cast("string").alias("value"), F.col(name).cast("string").alias("output")).write.partitionBy("output").mode("overwrite").option("lineSep", "\n").text(path)


def merge(df: DataFrame, template: Mapping[str, str], order_by: str, context: Context | None = None, **options) -> DataFrame:
    return _merge.merge(df, template, order_by, context, **options)


def merge_with(df: DataFrame, order_by: str, output: Column | Callable[[DataFrame], Column], name: str = "body") -> DataFrame:
    """A merge without a document: each record's output is any column, or what a function makes of the numbered records."""
    records = _merge.merge_records(df, order_by)
    return records.withColumn(name, output(records) if callable(output) else output)


__all__ = ["Context", "collect", "evaluate", "export", "format_of", "merge", "merge_with", "read_docx", "render", "write_files"]
