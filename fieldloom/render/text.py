"""Plain text: headings underlined, lists and quotes prefixed, notes, tables, comments, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.operators.views import author, in_order
from fieldloom.render.blocks import flag, joined, on

IMAGE = "[IMAGE]"


def heading(text: Column, level: Column) -> Column:
    """The text underlined, with ``=`` on level 1, else ``-``; three characters at least."""
    t = F.trim(text)
    return F.concat(t, F.lit("\n"), F.repeat(F.when(level == 1, "=").otherwise("-"), F.greatest(F.length(t), F.lit(3))))


def indent(points: Column, margin: Column | None = None) -> Column:
    """A blank for every four points beyond the section's margin, 40 at most."""
    left = F.greatest(F.lit(0.0), points - (F.lit(0.0) if margin is None else F.coalesce(margin, F.lit(0.0))))
    return F.repeat(F.lit(" "), F.least(F.lit(40), F.bround(F.coalesce(left, F.lit(0.0)) / 4).cast("int")))


def paragraph(df: DataFrame) -> Column:
    """The block of a paragraph: blank lines behind it, one line break in tables. An empty one is only that."""
    text = F.rtrim(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))
    level, marker = flag(df, "heading", "int"), flag(df, "marker", "string")
    space = indent(F.coalesce(flag(df, "indent", "double"), F.lit(0.0)), flag(df, "margin", "double"))
    mark = F.when(F.length(marker) > 0, F.concat(marker, F.lit(" "))).otherwise("")
    prefix = F.when(level.isNotNull(), space).otherwise(F.concat(F.when(on(df, "is_quote"), "> ").otherwise(""), space, mark, F.when(on(df, "is_code"), "    ").otherwise("")))
    body = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(prefix, line)), "\n")
    shown = F.when(F.length(text) == 0, "").when(level.isNotNull(), heading(body, level)).otherwise(body)
    return F.concat(shown, F.when(on(df, "in_table"), "\n").otherwise("\n\n"))


def document(df: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc, body) of paragraphs; ``keep`` names the flag of the view, such as keep_accept."""
    return joined(df if keep is None else df.filter(F.col(keep)), paragraph(df))


#: Labels of core properties in their order.
LABELS = (("title", "Title"), ("subject", "Subject"), ("creator", "Author"), ("description", "Description"), ("category", "Category"), ("keywords", "Keywords"), ("lastModifiedBy", "LastModifiedBy"), ("revision", "Revision"), ("created", "Created"), ("modified", "Modified"))


def property_lines(properties: DataFrame, custom: bool = True) -> DataFrame:
    """(doc, label, value, ord) of the properties to show: core ones in their fixed order, then custom ones. Dates are UTC."""
    names = F.create_map(*(F.lit(x) for i, (k, v) in enumerate(LABELS) for x in (k, v)))
    ranks = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(LABELS) for x in (k, i)))
    when = F.date_format(F.col("value").try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss'Z'")
    value = F.when(F.col("name").isin("created", "modified"), F.coalesce(when, F.col("value"))).otherwise(F.col("value"))
    core = properties.filter("kind = 'core'").select("doc", names[F.col("name")].alias("label"), value.alias("value"), ranks[F.col("name")].alias("ord")).filter("label IS NOT NULL")
    out = core.filter(F.trim("value") != "")
    if custom:
        own = properties.filter("kind = 'custom' AND value IS NOT NULL").select("doc", F.col("name").alias("label"), "value", F.lit(len(LABELS)).alias("ord"))
        out = out.unionByName(own)
    return out


def property_header(properties: DataFrame, custom: bool = True) -> DataFrame:
    """(doc, header): a line for each property and an empty line; nothing without any."""
    lines = property_lines(properties, custom).withColumn("line", F.concat("label", F.lit(": "), "value"))
    return lines.groupBy("doc").agg(F.concat(F.array_join(in_order(F.col("line"), F.col("ord"), F.col("label")), "\n"), F.lit("\n\n")).alias("header"))


def comments(threads: DataFrame) -> DataFrame:
    """(doc, root_id, body) of threads as ``views.comment_threads`` gives them, with author, initials, date and text."""
    who = author(F.col("author"), F.col("initials"))
    when = F.date_format(F.col("date").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(F.lit("  "), who, F.coalesce(F.concat(F.lit(" on "), when), F.lit("")), F.lit(":\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return threads.groupBy("doc", "root_id").agg(F.concat(F.lit("[COMMENTS for "), F.first("root_id"), F.lit("]\n"), F.array_join(in_order(line, F.col("position")), "\n"), F.lit("\n")).alias("body"))


def hyperlink(text: Column, href: Column) -> Column:
    return F.when(F.length(href) > 0, F.concat(text, F.lit(" ("), href, F.lit(")"))).otherwise(text)


def image(alt: Column) -> Column:
    return F.concat(F.lit(f"{IMAGE}: "), F.coalesce(alt, F.lit("image")))
