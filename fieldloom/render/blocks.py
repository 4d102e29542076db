"""What all renderers share: the table of paragraphs made from a document's nodes, and the order of its blocks.

A paragraph is a row with ``doc, ord, text`` and flags: ``heading`` (level or null), ``is_quote``, ``is_code``,
``is_caption``, ``marker`` (of a list), ``indent`` (points), ``in_table``, ``keep_accept``, ``keep_reject``. Flags a table
lacks are off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.operators import cells, views
from fieldloom.operators.views import in_order

#: Ids of built-in styles.
QUOTES, CODES, CAPTION, SUBTITLE = ("quote", "intensequote", "blocktext"), ("htmlpreformatted", "htmlcode", "code"), "caption", "subtitle"
TEXT = ("text", "tab", "break", "hyphen")


def flag(df: DataFrame, name: str, kind: str = "boolean") -> Column:
    held = {c.lower(): c for c in df.columns}.get(name)
    return F.lit(None).cast(kind) if held is None else F.col(held)


def on(df: DataFrame, name: str) -> Column:
    return F.coalesce(flag(df, name), F.lit(False))


def joined(df: DataFrame, block: Column, gap: str = "", order: str = "ord") -> DataFrame:
    """(doc, body): the blocks of each document in order."""
    return df.groupBy("doc").agg(F.array_join(in_order(block, F.col(order)), gap).alias("body"))


def caps(text: Column, props: Column) -> Column:
    return F.when((props["caps"] == "true") | (props["smallCaps"] == "true"), F.upper(text)).otherwise(text)


def paragraphs(nodes: DataFrame, styles: DataFrame | None = None, accept: bool = True) -> DataFrame:
    """Paragraphs of the main story of each document from its nodes: the accepted or the rejected text. Those with nothing to
    show (no text, picture, break, tab or field) aren't there."""
    main = nodes.filter("story = 'main'")
    keep = F.col("keep_accept" if accept else "keep_reject")
    leaf = F.when(keep & F.col("kind").isin(*TEXT), caps(F.coalesce("text", F.lit("")), F.col("props")))
    body = main.filter("paragraph IS NOT NULL AND kind <> 'paragraph'").groupBy("doc", F.col("paragraph").alias("ord")).agg(F.array_join(in_order(leaf, F.col("ord")), "").alias("text"), F.bool_or(F.col("kind").isin("drawing", "break", "tab", "field", "instruction") | (F.col("kind").isin("text", "hyphen", "symbol") & (F.length("text") > 0))).alias("renderable"))
    heads = main.filter("kind = 'paragraph'").select("doc", "ord", "block", "row", "cell", "keep_accept", "keep_reject", F.col("props")["style"].alias("style_id"), F.col("props")["outline"].cast("int").alias("outline"), F.col("props")["para_id"].alias("para_id"), F.col("props")["jc"].alias("align"), F.col("props")["num_id"].cast("int").alias("num_id"), F.col("props")["ilvl"].cast("int").alias("ilvl"), (F.col("props")["ind_left"].cast("double") / 20).alias("indent"))
    out = heads.join(body.filter("renderable").drop("renderable"), ["doc", "ord"]).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("in_table", F.col("row").isNotNull())
    if styles is None:
        chain = F.array("style_id")
    else:
        held = views.style_chains(styles).groupBy("doc", "style_id").agg(in_order(F.col("ancestor"), F.col("level")).alias("chain"), in_order(F.coalesce("name", "ancestor"), F.col("level")).alias("names"))
        out = out.join(held, ["doc", "style_id"], "left")
        chain = F.coalesce(F.col("chain"), F.array("style_id"))
    lower = F.transform(F.array_compact(chain), lambda s: F.lower(s))
    names = F.concat(F.coalesce(F.col("names"), F.array().cast("array<string>")), lower) if styles is not None else lower
    numbered = F.col("num_id") > 0
    level = F.when(~F.coalesce(numbered, F.lit(False)), F.coalesce(views.heading_level(F.col("outline"), names), F.when(F.array_contains(lower, SUBTITLE), 2)))
    out = out.withColumn("heading", level).withColumn("is_quote", F.arrays_overlap(lower, F.array(*map(F.lit, QUOTES)))).withColumn("is_code", F.arrays_overlap(lower, F.array(*map(F.lit, CODES)))).withColumn("is_caption", F.array_contains(lower, CAPTION))
    return out.drop("names", "chain")


def table_cells(nodes: DataFrame, df: DataFrame) -> DataFrame:
    """(doc, ord, row, cell, text, header, span, continues) of the tables of a document: the paragraphs of a cell on lines of
    their own; ``ord`` is the table's place in the document."""
    kinds = lambda k: nodes.filter((F.col("story") == "main") & (F.col("kind") == k))
    tables = kinds("table").groupBy("doc", "block").agg(F.min("ord").alias("ord"))
    heads = kinds("row").groupBy("doc", "block", "row").agg(F.bool_or(F.coalesce(F.col("props")["header"] == "true", F.lit(False))).alias("header"))
    spans = kinds("cell").groupBy("doc", "block", "row", "cell").agg(F.max(F.col("props")["span"].cast("int")).alias("span"), F.bool_or(F.coalesce(F.col("props")["continues"] == "true", F.lit(False))).alias("continues"))
    body = df.filter("row IS NOT NULL").groupBy("doc", "block", "row", "cell").agg(F.array_join(in_order(F.col("text"), F.col("ord")), "\n").alias("text"))
    out = spans.join(body, ["doc", "block", "row", "cell"], "left").join(heads, ["doc", "block", "row"]).join(tables, ["doc", "block"])
    return out.withColumn("text", F.coalesce("text", F.lit(""))).drop("block")


def with_tables(nodes: DataFrame, df: DataFrame, block: Callable[[DataFrame], Column], table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, ord, shown): paragraphs outside of tables as blocks, and tables as ``table`` makes them (doc, ord, shown) of cells."""
    free = df.filter("row IS NULL")
    return free.select("doc", "ord", block(free).alias("shown")).unionByName(table(table_cells(nodes, df)).select("doc", "ord", "shown"))


def ascii_tables(held: DataFrame) -> DataFrame:
    made = cells.ascii_table(held, ["doc", "ord"], "row", "cell", "text", F.col("header"), "shown")
    return made.withColumn("shown", F.concat("shown", F.lit("\n\n")))


def html_tables(held: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    grid = cells.grid(held, ["doc", "ord"], "row", "cell", "span", "continues").withColumn("text", F.replace(encode(F.col("text")), F.lit("\n"), F.lit("<br>")))
    made = cells.html_table(grid, ["doc", "ord"], "row", "col", "text", header=F.col("header"), name="shown")
    return made.withColumn("shown", F.concat("shown", F.lit("\n")))


def pipe_tables(held: DataFrame) -> DataFrame:
    """Markdown tables: the first row is the head, line breaks are blanks, bars are escaped."""
    cell = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    rows = held.groupBy("doc", "ord", "row").agg(F.concat(F.lit("| "), F.array_join(in_order(cell, F.col("cell")), " | "), F.lit(" |")).alias("line"), F.count("*").alias("n"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n").cast("int")))
    line = F.when(F.col("row") == 0, F.concat("line", rule)).otherwise(F.col("line"))
    return rows.groupBy("doc", "ord").agg(F.concat(F.array_join(in_order(line, F.col("row")), "\n"), F.lit("\n\n")).alias("shown"))
