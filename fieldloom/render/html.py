"""HTML: paragraphs with classes and computed styles, tables with spans, pictures in frames, an embedded stylesheet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions.text import html_attribute, html_text
from fieldloom.functions.values import number_text
from fieldloom.render.blocks import flag, joined, on

STYLESHEET = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{padding:4px}.align-center{text-align:center}.align-right{text-align:right}.align-justify{text-align:justify}"


@dataclass(frozen=True)
class Options:
    alignment: bool = True
    metadata: bool = False
    stylesheet: bool = True


RICH, PLAIN = Options(), Options(alignment=False, stylesheet=False)


def points(x: Column) -> Column:
    """A length with up to three decimals."""
    return F.concat(number_text(F.round(x, 3)), F.lit("pt"))


def paragraph_css(margin_left: Column, text_indent: Column, top: Column, bottom: Column, align: Column | None = None, line_height: Column | None = None, borders: dict[str, Column] | None = None, background: Column | None = None) -> Column:
    """Computed styles in a fixed order; null lengths are left out, and so are a left margin and an indent of nothing."""
    parts = [
        F.when(margin_left > 0.0001, F.concat(F.lit("margin-left:"), points(margin_left), F.lit(";"))),
        F.when(F.abs(text_indent) > 0.0001, F.concat(F.lit("text-indent:"), points(text_indent), F.lit(";"))),
        F.when(top.isNotNull(), F.concat(F.lit("margin-top:"), points(top), F.lit(";"))),
        F.when(bottom.isNotNull(), F.concat(F.lit("margin-bottom:"), points(bottom), F.lit(";"))),
    ]
    if align is not None:
        parts.append(F.when(align.isNotNull(), F.concat(F.lit("text-align:"), align, F.lit(";"))))
    if line_height is not None:
        parts.append(F.when(F.length(line_height) > 0, F.concat(F.lit("line-height:"), line_height, F.lit(";"))))
    for side in ("top", "right", "bottom", "left"):
        if borders and side in borders:
            parts.append(F.when(borders[side].isNotNull(), F.concat(F.lit(f"border-{side}:"), borders[side], F.lit(";"))))
    if background is not None:
        parts.append(F.when(F.length(background) > 0, F.concat(F.lit("background-color:"), background, F.lit(";"))))
    return F.concat_ws("", *parts)


#: Styles of Word's borders in CSS.
BORDERS = {"single": "solid", "thick": "solid", "double": "double", "dotted": "dotted", "dashed": "dashed", "dashSmallGap": "dashed", "dotDash": "dashed", "wave": "solid", "inset": "inset", "outset": "outset"}


def border(kind: Column, eighths: Column, color: Column) -> Column:
    """A border of a paragraph or cell; null for none."""
    style = F.create_map(*(F.lit(x) for kv in BORDERS.items() for x in kv))[kind]
    ink = F.when(color.isNull() | (color == "auto"), "#000000").otherwise(F.concat(F.lit("#"), color))
    return F.when(~F.coalesce(kind, F.lit("none")).isin("none", "nil"), F.concat(points(F.coalesce(eighths, F.lit(4)).cast("double") / 8), F.lit(" "), F.coalesce(style, F.lit("solid")), F.lit(" "), ink))


def paragraph(df: DataFrame, options: Options = RICH) -> Column:
    """A heading, caption, code block or paragraph; quotes have a wrapper. Headings, quotes and code show no marker, and a
    numbered heading is a paragraph, so ``heading`` is null there. Empty paragraphs are a line break."""
    level, marker = flag(df, "heading", "int"), flag(df, "marker", "string")
    quote, code, caption = on(df, "is_quote"), on(df, "is_code"), on(df, "is_caption")
    tag = F.when(level.isNotNull(), F.concat(F.lit("h"), level.cast("string"))).when(caption, "figcaption").when(code, "pre").otherwise("p")
    named = F.when(level.isNotNull(), F.concat(F.lit("dxp-heading dxp-heading-"), level.cast("string"))).when(caption, "dxp-caption").when(code, "dxp-code").otherwise("dxp-paragraph")
    align = flag(df, "align", "string")
    justify = F.when(align.isin("center", "right"), align).when(align.isin("both", "distribute"), "justify")
    if options.alignment:
        named = F.concat(named, F.coalesce(F.concat(F.lit(" align-"), justify), F.lit("")))
    css = flag(df, "css", "string")
    attributes = F.concat(F.lit(' class="'), named, F.lit('"'), F.when(F.length(css) > 0, F.concat(F.lit(' style="'), css, F.lit('"'))).otherwise(""))
    if options.metadata:
        para = flag(df, "para_id", "string")
        attributes = F.concat(attributes, F.when(F.length(para) > 0, F.concat(F.lit(' data-para-id="'), html_attribute(para), F.lit('"'))).otherwise(""))
    shown_marker = F.when(level.isNull() & ~quote & ~code & (F.length(marker) > 0), F.concat(F.lit('<span class="dxp-marker">'), html_text(marker), F.lit("</span> "))).otherwise("")
    body = html_text(F.col("text"))
    inner = F.when(code, F.concat(F.lit("<code>"), body, F.lit("</code>"))).otherwise(body)
    block = F.concat(F.lit("<"), tag, attributes, F.lit(">"), shown_marker, inner, F.lit("</"), tag, F.lit(">"))
    block = F.when(quote, F.concat(F.lit('<blockquote class="dxp-blockquote">\n'), block, F.lit("</blockquote>\n"))).otherwise(F.concat(block, F.lit("\n")))
    return F.when(F.length(F.col("text")) == 0, "\n").otherwise(block)


def document(df: DataFrame, options: Options = RICH, keep: str | None = None) -> DataFrame:
    return framed(joined(df if keep is None else df.filter(F.col(keep)), paragraph(df, options)), options)


def framed(out: DataFrame, options: Options = RICH) -> DataFrame:
    """The body as a page, with the stylesheet embedded on request."""
    head = f"<style>{STYLESHEET}</style>\n" if options.stylesheet else ""
    return out.withColumn("body", F.concat(F.lit(f"<!DOCTYPE html>\n<html><head>{head}</head><body>\n"), "body", F.lit("</body></html>\n")))


def image(uri: Column, alt: Column, width: Column | None = None, height: Column | None = None, crop: dict[str, Column] | None = None, rotation: Column | None = None, flip_h: Column | None = None, flip_v: Column | None = None) -> Column:
    """A picture, or ``[DRAWING: alt]`` without one. Lengths are points; ``crop`` has the share cut from each side (l, t, r, b);
    a cropped picture stands in a frame that hides what is cut off."""
    label = F.coalesce(alt, F.lit("image"))
    parts = []
    if width is not None:
        parts.append(F.when(width.isNotNull(), F.concat(F.lit("width:"), points(width), F.lit(";"))))
    if height is not None:
        parts.append(F.when(height.isNotNull(), F.concat(F.lit("height:"), points(height), F.lit(";"))))
    turns = []
    if rotation is not None:
        turns.append(F.when(F.coalesce(rotation, F.lit(0)) % 360 != 0, F.concat(F.lit("rotate("), number_text(F.pmod(rotation, F.lit(360)).cast("double")), F.lit("deg)"))))
    turns += [F.when(F.coalesce(f, F.lit(False)), t) for f, t in ((flip_h, "scaleX(-1)"), (flip_v, "scaleY(-1)")) if f is not None]
    if turns:
        held = F.concat_ws(" ", *turns)
        parts.append(F.when(F.length(held) > 0, F.concat(F.lit("transform:"), held, F.lit(";"))))
    css = F.concat_ws("", *parts) if parts else F.lit("")
    style = F.when(F.length(css) > 0, F.concat(F.lit(' style="'), css, F.lit('"'))).otherwise("")
    plain = F.concat(F.lit('<img src="'), html_attribute(uri), F.lit('" alt="'), html_attribute(label), F.lit('"'), style, F.lit(">"))
    if crop is not None and width is not None and height is not None:
        cut = {k: F.coalesce(crop[k], F.lit(0.0)) for k in "ltrb"}
        full_w, full_h = width / (1 - cut["l"] - cut["r"]), height / (1 - cut["t"] - cut["b"])
        inner = F.concat(F.lit('<img src="'), html_attribute(uri), F.lit('" alt="'), html_attribute(label), F.lit('" style="position:absolute;width:'), points(full_w), F.lit(";height:"), points(full_h), F.lit(";left:"), points(-full_w * cut["l"]), F.lit(";top:"), points(-full_h * cut["t"]), F.lit(';">'))
        framed = F.concat(F.lit('<span style="display:inline-block;position:relative;overflow:hidden;'), css, F.lit('">'), inner, F.lit("</span>"))
        plain = F.when((cut["l"] + cut["t"] + cut["r"] + cut["b"]) > 0, framed).otherwise(plain)
    return F.when(uri.isNull(), F.concat(F.lit("[DRAWING: "), html_text(label), F.lit("]"))).otherwise(plain)


#: Fields that show page numbers.
PAGE_FIELDS = ("PAGE", "NUMPAGES", "SECTIONPAGES")


def without_page_numbers(df: DataFrame, instruction: str = "instruction") -> DataFrame:
    """Rows without results of page number fields."""
    first = F.upper(F.regexp_extract(F.coalesce(instruction, F.lit("")), r"^\s*(\S+)", 1))
    return df.filter(~first.isin(*PAGE_FIELDS))
