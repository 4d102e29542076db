"""Markdown, rich (with HTML for what Markdown lacks) and plain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions.text import html_attribute, html_text
from fieldloom.operators.views import author, in_order
from fieldloom.render.blocks import flag, joined, on
from fieldloom.render.text import property_lines


@dataclass(frozen=True)
class Options:
    """``rich`` writes headings, quotes, code and comments as HTML elements."""

    rich: bool = True
    layout: bool = False
    alignment: bool = True
    custom_properties: bool = True
    timeline: bool = False
    keep_symbols: bool = False
    field_instructions: bool = False


RICH, PLAIN = Options(), Options(rich=False, alignment=False)


def marker(text: Column, escape: bool = True) -> Column:
    """Bullets of all kinds are round ones; a number with its mark is escaped, so that it starts no list."""
    bare = F.trim(F.regexp_replace(text, "<[^>]*>", ""))
    shown = F.when(bare.rlike(r"^[•·]$"), "•").otherwise(bare)
    return F.when(shown.rlike(r"^\d+[.)]$"), F.regexp_replace(shown, r"^(\d+)([.)])$", r"$1\\$2")).otherwise(shown) if escape else shown


def instruction(text: Column) -> Column:
    """A field's instruction: fenced if it has a line break or more than 80 characters, else inline with back-quotes doubled."""
    t = F.trim(text)
    fenced = F.concat(F.lit("\n\n```\n"), t, F.lit("\n```\n\n"))
    return F.when(F.length(t) == 0, "").when(t.contains("\n") | (F.length(t) > 80), fenced).otherwise(F.concat(F.lit("\n\n`"), F.replace(t, F.lit("`"), F.lit("``")), F.lit("`\n\n")))


def text(x: Column) -> Column:
    return html_text(x)


def paragraph(df: DataFrame, options: Options = RICH) -> Column:
    level, css = flag(df, "heading", "int"), flag(df, "css", "string")
    align = flag(df, "align", "string")
    justify = F.when(align.isin("center", "right"), align).when(align.isin("both", "distribute"), "justify")
    body = html_text(F.col("text"))
    quote, code, caption = on(df, "is_quote"), on(df, "is_code"), on(df, "is_caption")
    plain_block = level.isNull() & ~quote
    wrapped = F.lit(options.layout) & level.isNull() & (F.length(css) > 0)
    mark = F.when(level.isNull() & ~quote & ~code & flag(df, "marker", "string").isNotNull(), F.concat(marker(flag(df, "marker", "string")), F.lit(" "))).otherwise("")
    if options.rich:
        style = F.when(F.lit(options.alignment) & justify.isNotNull(), F.concat(F.lit(' style="text-align:'), justify, F.lit(';"'))).otherwise("")
        tag = F.concat(F.lit("h"), level.cast("string"))
        head = F.concat(F.lit("<"), tag, style, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
        quoted = F.concat(F.lit("<blockquote>"), F.when(code, F.concat(F.lit("<pre><code>"), body, F.lit("</code></pre>"))).otherwise(body), F.lit("</blockquote>\n"))
        coded = F.concat(F.lit("<pre><code>"), body, F.lit("</code></pre>"))
        captioned = F.when(caption & plain_block, F.concat(F.lit("<figcaption>"), F.when(code, coded).otherwise(body), F.lit("</figcaption>"))).when(code, coded).otherwise(body)
    else:
        head = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)
        coded = F.concat(F.lit("```\n"), body, F.lit("\n```\n"))
        quoted = F.concat(F.lit("> "), F.when(code, coded).otherwise(body))
        captioned = F.when(code, coded).otherwise(body)
    shown = F.when(level.isNotNull(), head).when(quote, quoted).otherwise(F.concat(mark, captioned))
    shown = F.when(wrapped, F.concat(F.lit('<p style="'), css, F.lit('">'), shown, F.lit("</p>\n"))).otherwise(shown)
    return F.when(F.length(F.col("text")) == 0, "\n").otherwise(F.concat(shown, F.lit("\n\n")))


def document(df: DataFrame, options: Options = RICH, keep: str | None = None) -> DataFrame:
    return joined(df if keep is None else df.filter(F.col(keep)), paragraph(df, options))


def property_header(properties: DataFrame, options: Options = RICH, timeline: DataFrame | None = None) -> DataFrame:
    """(doc, header): properties as HTML comments, and on request the timeline, as a table in rich Markdown."""
    lines = property_lines(properties, options.custom_properties).select("doc", F.concat(F.lit("<!-- "), "label", F.lit(": "), "value", F.lit(" -->")).alias("line"), F.col("ord").alias("a"), F.col("label").alias("b"))
    out = lines.groupBy("doc").agg(F.concat(F.array_join(in_order(F.col("line"), F.col("a"), F.col("b")), "\n"), F.lit("\n\n")).alias("header"))
    if not options.timeline or timeline is None:
        return out
    who = F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("unknown"))
    if options.rich:
        when = F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("unknown"))
        line = F.concat(F.lit("| "), when, F.lit(" | "), "kind", F.lit(" by "), who, F.lit(" |"))
        frame = ("\n| Date | Event |\n| --- | --- |\n", "\n\n")
    else:
        when = F.coalesce(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown"))
        line = F.concat(F.lit("<!-- Timeline: "), when, F.lit(" - "), "kind", F.lit(" by "), who, F.lit(" -->"))
        frame = ("", "\n\n")
    events = timeline.groupBy("doc").agg(F.concat(F.lit(frame[0]), F.array_join(in_order(line, F.col("position")), "\n"), F.lit(frame[1])).alias("events"))
    return out.join(events, "doc", "full").select("doc", F.concat(F.coalesce("header", F.lit("")), F.coalesce("events", F.lit(""))).alias("header"))


def comments(threads: DataFrame, options: Options = RICH) -> DataFrame:
    """(doc, root_id, body): in plain Markdown an HTML comment, in rich Markdown boxes."""
    who = author(F.col("author"), F.col("initials"))
    when = F.date_format(F.col("date").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    words = F.coalesce("text", F.lit(""))
    if options.rich:
        label = F.concat(F.lit('  <span style="font-size:small">'), html_attribute(who), F.lit(" | "), html_attribute(F.coalesce(when, F.lit(""))), F.lit("</span>\n"))
        line, frame = F.concat(label, F.lit('  <div class="comment">\n'), html_text(words), F.lit("\n  </div>\n\n")), ('<div class="comments">', "</div>\n\n")
    else:
        label = F.concat(F.lit("  "), F.when(F.col("is_reply"), "REPLY BY ").otherwise("COMMENT BY "), who, F.coalesce(F.concat(F.lit(" ON "), when), F.lit("")))
        line, frame = F.concat(label, F.lit("\n\n"), words, F.lit("\n\n")), ("<!--\n\n", "-->\n\n")
    return threads.groupBy("doc", "root_id").agg(F.concat(F.lit(frame[0]), F.array_join(in_order(line, F.col("position")), ""), F.lit(frame[1])).alias("body"))


def hyperlink(text: Column, href: Column) -> Column:
    return F.when(F.length(href) > 0, F.concat(F.lit('<a href="'), html_attribute(href), F.lit('">'), text, F.lit("</a>"))).otherwise(text)
