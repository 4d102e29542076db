"""Counters over document order: sequences, automatic numbers, list markers, notes.

A counter with resets is a running total less the total at the last reset, so all levels of a document share one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.pictures import list_number
from fieldloom.functions.values import parse_number

LEVELS = 9


def _along(doc: list[str], order: list[str]):
    return Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def sequence(df: DataFrame, doc: list[str], order: list[str], name: str = "seq", reset: Column | None = None, repeat: Column | None = None, bookmark: Column | None = None, outline: Column | None = None) -> DataFrame:
    """SEQ: adds the counter of a field occurrence; ``doc`` has the document and the identifier.

    ``reset`` (\\r) is a number to show and go on from, or null. ``repeat`` marks \\c. ``bookmark`` is the text of a bookmark
    whose number, rounded down, is shown and gone on from. ``outline`` is the outline level at a field with \\s (null without
    it): where it differs from the last one above 0, counting starts anew.
    """
    along = _along(doc, order)
    step = F.lit(1) if repeat is None else F.when(F.coalesce(repeat, F.lit(False)), 0).otherwise(1)
    sets = F.lit(None).cast("long") if reset is None else reset.cast("long")
    if bookmark is not None:  # set later, so it wins
        sets = F.coalesce(F.floor(parse_number(bookmark)), sets)
    out = df.withColumn("_set", sets).withColumn("_step", F.when(F.col("_set").isNotNull(), 0).otherwise(step))
    start = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_total").alias("t")))
    if outline is not None:
        seen = F.when(outline > 0, outline)
        before = F.last(seen, True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("_anew", F.coalesce(seen.isNotNull() & ~before.eqNullSafe(seen), F.lit(False)))
        start = F.coalesce(start, F.when(F.col("_anew"), F.struct(F.lit(0).cast("long").alias("v"), (F.col("_total") - F.col("_step")).alias("t"))))
    out = out.withColumn("_total", F.sum("_step").over(along)).withColumn("_start", F.last(start, True).over(along))
    value = F.coalesce(F.col("_start.v") + F.col("_total") - F.col("_start.t"), F.col("_total"))
    return out.withColumn(name, value.cast("long")).drop("_total", "_start", "_set", "_step", "_anew")


def hidden(value: Column, hide: Column, starred: Column) -> Column:
    """The text of a counter: nothing with \\h, unless a \\* switch shows it; it has counted all the same."""
    return F.when(hide & ~starred, "").otherwise(value.cast("string"))


def level_counters(df: DataFrame, doc: list[str], order: list[str], level: Column, counts: Column | None = None, prefix: str = "_c") -> DataFrame:
    """Adds ``<prefix>1`` to ``<prefix>9``: how often each level (1 to 9; null is none) has come since the last lower one.
    Rows that ``counts`` is false for count for none and reset nothing."""
    along = _along(doc, order)
    lv = level if counts is None else F.when(counts, level)
    out = df.withColumn("_lv", lv)
    out = out.select("*", *(F.sum(F.when(F.col("_lv") == i, 1).otherwise(0)).over(along).alias(f"_n{i}") for i in range(1, LEVELS + 1)))
    since = [F.coalesce(F.last(F.when(F.col("_lv") < i, F.col(f"_n{i}")), True).over(along), F.lit(0)) for i in range(1, LEVELS + 1)]
    out = out.select("*", *(s.alias(f"_s{i}") for i, s in enumerate(since, 1)))
    made = [(F.col(f"_n{i}") - F.col(f"_s{i}")).cast("int").alias(f"{prefix}{i}") for i in range(1, LEVELS + 1)]
    return out.select(*df.columns, *made)


#: Formats of an outline number by depth.
OUTLINE_FORMATS = ("upperRoman", "upperLetter", "decimal", "lowerLetter", "lowerRoman", "decimal", "lowerLetter", "lowerRoman", "decimal")


def auto_numbers(df: DataFrame, doc: list[str], order: list[str], heading: Column, family: str = "AUTONUM", separator: str = ".", end: bool = True, name: str = "autonum", culture: Culture = EN) -> DataFrame:
    """AUTONUM, AUTONUMLGL or AUTONUMOUT fields of stories (``doc``): adds the number's text.

    ``heading`` is the built-in heading level of the field's paragraph, null or 0 in body text. Headings have a counter for
    each level, body fields one that starts anew behind each heading. Legal and outline numbers show the whole path.
    """
    along = _along(doc, order)
    lv = F.when(heading > 0, F.least(heading, F.lit(LEVELS)))
    out = level_counters(df.withColumn("_heading", lv), doc, order, F.col("_heading"))
    body = F.sum(F.when(F.col("_heading").isNull(), 1).otherwise(0)).over(along)
    out = out.withColumn("_body", body)
    out = out.withColumn("_body", F.col("_body") - F.coalesce(F.last(F.when(F.col("_heading").isNotNull(), F.col("_body")), True).over(along), F.lit(0)))
    counters = [F.col(f"_c{i}") for i in range(1, LEVELS + 1)]
    value = F.when(F.col("_heading").isNull(), F.col("_body")).otherwise(F.get(F.array(*counters), F.col("_heading") - 1))
    if family == "AUTONUM":
        shown = F.concat(value.cast("string"), F.lit(separator))
    else:
        active = F.greatest(*(F.when(c > 0, i).otherwise(0) for i, c in enumerate(counters, 1)))
        depth = F.coalesce(F.col("_heading"), active)
        path = F.slice(F.array(*(F.greatest(c, F.lit(1)) for c in counters)), F.lit(1), depth)
        parts = F.when(F.col("_heading").isNull(), F.concat(path, F.array(F.col("_body").cast("int")))).otherwise(path)
        out, parts = out.withColumn("_path", parts), F.col("_path")
        if family == "AUTONUMOUT":
            styles = [*OUTLINE_FORMATS, OUTLINE_FORMATS[-1]]
            labels = F.array(*(F.when(F.size(parts) > i, list_number(F.get(parts, i), s, culture)) for i, s in enumerate(styles)))
            shown = F.concat(F.array_join(F.array_compact(labels), separator), F.lit(separator))
        else:
            shown = F.concat(F.array_join(F.transform(parts, lambda x: x.cast("string")), separator), F.lit(separator if end else ""))
    return out.withColumn(name, shown).select(*df.columns, name)


def list_markers(df: DataFrame, doc: list[str], order: list[str], level: str, definitions: dict[int, tuple[str, str, int]], name: str = "marker", counts: Column | None = None, culture: Culture = EN) -> DataFrame:
    """The marker of each list paragraph: ``doc`` has the document and the list, ``level`` is 0 to 8.

    ``definitions`` gives number format, marker text (``%1.%2``) and start of each level. A level of format ``none`` shows
    its text and counts nothing; one without a text shows nothing and counts nothing; bullets show their text and count.
    ``counts`` tells paragraphs that count in this view, such as those an accepted document keeps.
    """
    lv = F.col(level) + 1
    real = [i for i, (style, shown, _) in definitions.items() if style != "none" and shown]
    counted = F.col(level).isin(real) if real else F.lit(False)
    held = level_counters(df, doc, order, lv, counted if counts is None else counted & counts)
    held = held.select("*", *(F.when(F.col(f"_c{i + 1}") > 0, F.col(f"_c{i + 1}") - 1 + definitions[i][2]).otherwise(0).alias(f"_v{i}") for i in range(LEVELS) if i in definitions))
    value = {i: F.col(f"_v{i}") if i in definitions else F.lit(0) for i in range(LEVELS)}
    marker: Column = F.lit(None).cast("string")
    for i, (style, shown, _) in sorted(definitions.items()):
        if not shown:
            continue
        parts: Column = F.lit(shown)
        if style not in ("none", "bullet"):
            for k in range(LEVELS):
                if f"%{k + 1}" in shown:
                    parts = F.replace(parts, F.lit(f"%{k + 1}"), list_number(value[k], definitions.get(k, ("decimal", "", 1))[0], culture))
        marker = F.when(F.col(level) == i, parts).otherwise(marker)
    return held.withColumn(name, marker).select(*df.columns, name)


#: Kinds of notes that are separators and have no number.
SEPARATORS = ("separator", "continuationSeparator", "continuationNotice")


def note_numbers(df: DataFrame, doc: list[str], order: list[str], kind: Column, name: str = "index") -> DataFrame:
    """Notes that aren't separators, with their 1-based index in the part."""
    w = Window.partitionBy(*doc).orderBy(*order)
    return df.filter(~F.coalesce(kind, F.lit("")).isin(*SEPARATORS)).withColumn(name, F.row_number().over(w))
