"""Relational views of documents: chains and look-ups of styles, numbering, comment threads, bookmarks, sections, the
timeline, captions, included documents. All are joins, windows and ordered aggregates over tables of rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def in_order(text: Column, *order: Column) -> Column:
    """Aggregate: texts in the order of the given columns, nulls left out."""
    held = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("t")))))
    return F.transform(held, lambda x: x["t"])


# ---- chains


def ancestors(df: DataFrame, scope: list[str], id_: str, parent: str) -> DataFrame:
    """(scope, id, ancestor, level): every row itself at level 0, then its parents, as far as they exist. A chain ends where
    it would come back to a row it has been at. One join a level, until a level is empty; the narrow table of links and the
    levels are kept, as each is read twice (kept rows that are lost are computed again)."""
    nodes = df.select(*scope, F.col(id_).alias("id"), F.col(parent).alias("up")).dropDuplicates([*scope, "id"]).persist()
    here = nodes.select(*scope, "id", F.col("id").alias("ancestor"), F.col("up"), F.lit(0).alias("level"), F.array("id").alias("seen"))
    levels = [here]
    while True:
        # The join's condition is on names of its own, as both sides come from one table.
        parents = nodes.select(*(F.col(c).alias(f"_p_{c}") for c in scope), F.col("id").alias("_p_id"), F.col("up").alias("_p_up"))
        on = [here[c] == parents[f"_p_{c}"] for c in scope] + [here["up"] == parents["_p_id"]]
        here = here.join(parents, reduce(lambda a, b: a & b, on)).filter(~F.array_contains("seen", F.col("_p_id")))
        here = here.select(*scope, "id", F.col("_p_id").alias("ancestor"), F.col("_p_up").alias("up"), (F.col("level") + 1).alias("level"), F.concat("seen", F.array("_p_id")).alias("seen")).persist()
        if here.isEmpty():
            break
        levels.append(here)
    return reduce(DataFrame.unionByName, levels).select(*scope, "id", "ancestor", "level")


def roots(df: DataFrame, scope: list[str], id_: str, parent: str) -> DataFrame:
    """(scope, id, root): the last of each chain."""
    chain = ancestors(df, scope, id_, parent)
    return chain.groupBy(*scope, "id").agg(F.max_by("ancestor", "level").alias("root"))


# ---- comments


def comment_parents(comments: DataFrame, extended: DataFrame) -> DataFrame:
    """Comments with parent_id and done: the extended part knows comments by the id of their last paragraph."""
    by_para = comments.select("doc", "para_id", F.col("id").alias("parent_id")).filter("para_id IS NOT NULL").dropDuplicates(["doc", "para_id"])
    ex = extended.select("doc", "para_id", F.col("parent_para_id"), "done").dropDuplicates(["doc", "para_id"])
    parents = ex.join(by_para.withColumnRenamed("para_id", "parent_para_id"), ["doc", "parent_para_id"], "left").select("doc", "para_id", "parent_id", "done")
    return comments.join(parents, ["doc", "para_id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def comment_threads(df: DataFrame, scope: list[str], id_: str, parent: str, date: str) -> DataFrame:
    """Comments with root_id, is_reply and position in the thread: by date, those without one first, then by id as text."""
    held = _with_root(df, scope, id_, parent)
    w = Window.partitionBy(*scope, "root_id").orderBy(F.col(date).asc_nulls_first(), F.col(id_).cast("string"))
    known = F.col(parent).isNotNull() & (F.col("root_id") != F.col(id_))
    return held.withColumn("is_reply", known).withColumn("position", F.row_number().over(w))


def _with_root(df: DataFrame, scope: list[str], id_: str, parent: str) -> DataFrame:
    found = roots(df, scope, id_, parent).withColumnRenamed("id", id_).withColumnRenamed("root", "root_id")
    return df.join(found, [*scope, id_])


def first_anchors(anchors: DataFrame, scope: list[str], root: str, order: str) -> DataFrame:
    """A thread is shown once, at its first anchor."""
    w = Window.partitionBy(*scope, root).orderBy(order)
    return anchors.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def author(name: Column, initials: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(initials, F.lit("")), F.lit("Unknown"))


# ---- styles


def distinct_styles(styles: DataFrame) -> DataFrame:
    """Of styles of one id and type the last."""
    w = Window.partitionBy("doc", "style_id", "type").orderBy(F.col("ord").desc())
    return styles.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pick_styles(wanted: DataFrame, styles: DataFrame, id_: str, type_: str) -> DataFrame:
    """``wanted`` with the style of its id: that of the preferred type, else the first there is; nulls without any."""
    s = distinct_styles(styles).withColumnRenamed("doc", "_doc")
    best = F.struct(F.when(F.col("type") == F.col("_want"), 0).otherwise(1).alias("rank"), F.col("ord"))
    keys = wanted.select("doc", F.col(id_).alias("_id"), F.col(type_).alias("_want")).distinct()
    found = keys.join(s, (F.col("doc") == F.col("_doc")) & (F.lower("_id") == F.lower("style_id")))
    found = found.groupBy("doc", "_id", "_want").agg(F.min_by(F.struct("style_id", "type", "name", "based_on", "props"), best).alias("style"))
    on = (wanted["doc"] == found["doc"]) & (wanted[id_] == found["_id"]) & (wanted[type_].eqNullSafe(found["_want"]))
    return wanted.join(found, on, "left").select(wanted["*"], found["style"])


def style_chains(styles: DataFrame, type_: str = "paragraph") -> DataFrame:
    """(doc, style_id, ancestor, level, name, props): the basedOn chain of each style of a type, from derived to base."""
    held = distinct_styles(styles).filter(F.col("type") == type_)
    chain = ancestors(held, ["doc"], "style_id", "based_on")
    ends = held.select("doc", F.col("style_id").alias("ancestor"), "name", "props", "type")
    return chain.join(ends, ["doc", "ancestor"]).select("doc", F.col("id").alias("style_id"), "ancestor", "level", "name", "props")


def effective(df: DataFrame, keys: list[str], precedence: Column, props: str, names: list[str]) -> DataFrame:
    """Properties by precedence: of each name the value of the last row, from weak to strong, that has it. Defaults, chains
    from base to derived, and direct properties are rows of rising precedence."""
    return df.groupBy(*keys).agg(*(F.max_by(F.col(props)[n], F.when(F.col(props)[n].isNotNull(), precedence)).alias(n) for n in names))


def run_precedence(source: Column, level: Column) -> Column:
    """Document defaults, the paragraph style's chain, the paragraph's marks, the character style's chain, the run."""
    base = {"defaults": 0, "paragraph": 1, "mark": 2, "character": 3, "direct": 4}
    rank = reduce(lambda out, kv: F.when(source == kv[0], kv[1]).otherwise(out), base.items(), F.lit(-1))
    return rank * 1000 - F.coalesce(level, F.lit(0))


def heading_level(outline: Column, names: Column) -> Column:
    """Of a paragraph: the outline level (from 0) and 2, else the first name or id of its style chain, from derived to base,
    that tells a level: Title 1, Heading n one more than n; 1 to 9 only."""
    text = lambda x: F.lower(F.trim(x))
    one = lambda x: F.when(text(x) == "title", 1).when(text(x).rlike(r"^heading ?\d{1,4}$"), F.regexp_extract(text(x), r"(\d+)$", 1).cast("int") + 1)
    levels = F.filter(F.transform(names, one), lambda n: n.between(1, 9))
    return F.when(outline.between(0, 8), outline + 2).otherwise(F.get(levels, 0))


def effective_number(direct_id: Column, direct_level: Column, style_id: Column, style_level: Column) -> Column:
    """The list and level of a paragraph, or null: its own, where 0 means none, or else its styles'."""
    own = F.struct(direct_id.cast("int").alias("num_id"), F.coalesce(direct_level, F.lit(0)).cast("int").alias("ilvl"))
    styled = F.when(style_id > 0, F.struct(style_id.cast("int").alias("num_id"), F.coalesce(style_level, F.lit(0)).cast("int").alias("ilvl")))
    return F.when(direct_id.isNotNull(), F.when(direct_id != 0, own)).otherwise(styled)


def language(run: Column, paragraph_style: Column, character_style: Column, default: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (run, paragraph_style, character_style, default)))


# ---- numbering


def resolve_levels(wanted: DataFrame, numbering: DataFrame, style_numbers: DataFrame | None = None) -> DataFrame:
    """(doc, num_id, ilvl) with the definition of the level: format, text, start. A definition without levels goes on to the
    list of the style it links to (``style_numbers``: doc, style_id, num_id). A missing level is level 0, or else the lowest."""
    levels = numbering.filter("ilvl IS NOT NULL")
    if style_numbers is not None:
        links = numbering.filter("ilvl IS NULL AND style_link IS NOT NULL").select("doc", "num_id", F.col("style_link").alias("style_id"))
        target = links.join(style_numbers.select("doc", "style_id", F.col("num_id").alias("to")), ["doc", "style_id"]).select("doc", F.col("num_id").alias("from"), F.col("to").alias("num_id"))
        linked = target.join(levels, ["doc", "num_id"]).withColumn("num_id", F.col("from")).select(*levels.columns)
        levels = levels.unionByName(linked)
    keys = wanted.select("doc", "num_id", F.greatest(F.lit(0), F.least(F.lit(8), F.col("ilvl"))).alias("_at"), "ilvl").distinct()
    defs = levels.select("doc", "num_id", F.col("ilvl").alias("_lv"), "fmt", "lvl_text", "start")
    rank = F.struct(F.when(F.col("_lv") == F.col("_at"), 0).when(F.col("_lv") == 0, 1).otherwise(2).alias("r"), F.col("_lv"))
    best = keys.join(defs, ["doc", "num_id"]).groupBy("doc", "num_id", "ilvl").agg(F.min_by(F.struct("fmt", "lvl_text", "start"), rank).alias("level"))
    return wanted.join(best, ["doc", "num_id", "ilvl"], "left")


# ---- bookmarks


def bookmark_ranges(nodes: DataFrame) -> DataFrame:
    """(doc, name, start, end): each start with the first end of its id behind it; the first bookmark of a name."""
    starts = nodes.filter("kind = 'bookmark_start'").select("doc", F.col("props")["id"].alias("id"), F.col("text").alias("name"), F.col("ord").alias("start"))
    ends = nodes.filter("kind = 'bookmark_end'").select("doc", F.col("props")["id"].alias("id"), F.col("ord").alias("end"))
    pairs = starts.join(ends, ["doc", "id"]).filter("end > start").groupBy("doc", "id", "name", "start").agg(F.min("end").alias("end"))
    return pairs.groupBy("doc", F.upper("name").alias("key")).agg(F.min_by(F.struct("name", "start", "end"), "start").alias("b")).select("doc", "b.name", "b.start", "b.end")


def contained(ranges: DataFrame, rows: DataFrame, scope: list[str], start: str, end: str, position: str, width: int = 256) -> DataFrame:
    """Rows whose position lies strictly inside a range, joined on buckets of positions, so a long range meets only rows of
    its buckets; ranges may overlap."""
    spots = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    a = ranges.withColumn("_bucket", spots)
    b = rows.withColumn("_bucket", F.floor(F.col(position) / width))
    return a.join(b, [*scope, "_bucket"]).filter((F.col(position) > F.col(start)) & (F.col(position) < F.col(end))).drop("_bucket")


def bookmark_text(ranges: DataFrame, rows: DataFrame, scope: list[str], name: str, start: str, end: str, position: str, text: str, gap: str = "") -> DataFrame:
    """The text inside of each bookmark, in order; empty where there is none."""
    held = contained(ranges, rows, scope, start, end, position)
    got = held.groupBy(*scope, name).agg(F.array_join(in_order(F.col(text), F.col(position)), gap).alias("body"))
    return ranges.select(*scope, name).distinct().join(got, [*scope, name], "left").withColumn("body", F.coalesce("body", F.lit("")))


def first_in_bookmark(ranges: DataFrame, rows: DataFrame, scope: list[str], name: str, start: str, end: str, position: str, value: str) -> DataFrame:
    """Of what stands in a bookmark, such as a note's reference or a link, the first counts."""
    return contained(ranges, rows, scope, start, end, position).groupBy(*scope, name).agg(F.min_by(value, position).alias(value))


def referenced(bookmarks: DataFrame, references: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Bookmarks that a link or field refers to; names of bookmarks are compared without regard to case."""
    return bookmarks.withColumn("_key", F.upper(name)).join(references.select(*scope, F.upper(name).alias("_key")).distinct(), [*scope, "_key"], "left_semi").drop("_key")


def unreferenced(bookmarks: DataFrame, references: DataFrame, scope: list[str], name: str) -> DataFrame:
    return bookmarks.withColumn("_key", F.upper(name)).join(references.select(*scope, F.upper(name).alias("_key")).distinct(), [*scope, "_key"], "left_anti").drop("_key")


def reference_records(names: DataFrame, texts: DataFrame, numbers: DataFrame, footnotes: DataFrame, endnotes: DataFrame, links: DataFrame, scope: list[str], name: str) -> DataFrame:
    """What REF fields need of each bookmark: its text, paragraph number, first footnote, endnote and link, where it has them."""
    out = names.withColumn("_key", F.upper(name))
    for table in (texts, numbers, footnotes, endnotes, links):
        out = out.join(table.withColumn("_key", F.upper(name)).drop(name), [*scope, "_key"], "left")
    return out.drop("_key")


# ---- sections


def sections(nodes: DataFrame, scope: list[str], order: str, is_break: Column, name: str = "section") -> DataFrame:
    """The section of each row, from 1: a section's properties stand at its end."""
    before = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn(name, F.coalesce(F.sum(is_break.cast("int")).over(before), F.lit(0)) + 1)


def inherited(df: DataFrame, scope: list[str], order: str, references: dict[str, Column]) -> DataFrame:
    """Headers and footers of each section: its own, else those of the section before it."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(F.last(c, True).over(w).alias(k) for k, c in references.items()))


def choose_reference(selection: str, title_page: Column, default: Column, first: Column, even: Column, even_and_odd: Column) -> Column:
    """The header or footer to show: none, that of the first page or that of the last."""
    if selection.lower() == "none":
        return F.lit(None).cast("string")
    if selection.lower() == "first":
        return F.coalesce(F.when(title_page, first), default, F.when(even_and_odd, even), first)
    return F.coalesce(F.when(even_and_odd, even), default, first, even)


def neighbours(df: DataFrame, scope: list[str], order: str, style: str, contextual: Column, top: Column, bottom: Column, border_top: Column, border_bottom: Column) -> DataFrame:
    """Space and borders between paragraphs: space goes between two of one style if either asks for that; of equal borders
    in a row only the outer ones stay."""
    w = Window.partitionBy(*scope).orderBy(order)
    held = df.withColumn("_ctx", F.coalesce(contextual, F.lit(False))).withColumn("_top", top).withColumn("_bottom", bottom).withColumn("_bt", border_top).withColumn("_bb", border_bottom)
    held = held.select("*", *(f(c).over(w).alias(f"{n}{c}") for n, f in (("_p", F.lag), ("_n", F.lead)) for c in (style, "_ctx", "_bt", "_bb")))
    same = lambda n: F.coalesce((F.col(style) == F.col(f"{n}{style}")) & (F.col("_ctx") | F.coalesce(F.col(f"{n}_ctx"), F.lit(False))), F.lit(False))
    out = held.withColumn("space_top", F.when(same("_p"), 0.0).otherwise(F.col("_top"))).withColumn("space_bottom", F.when(same("_n"), 0.0).otherwise(F.col("_bottom")))
    out = out.withColumn("top_border", F.when(~F.col("_bt").eqNullSafe(F.col("_p_bt")), F.col("_bt"))).withColumn("bottom_border", F.when(~F.col("_bb").eqNullSafe(F.col("_n_bb")), F.col("_bb")))
    return out.select(*df.columns, "space_top", "space_bottom", "top_border", "bottom_border")


# ---- timeline


def timeline(events: list[DataFrame], scope: list[str]) -> DataFrame:
    """(scope, kind, author, date, source, position) of all events: by date, those without one last; equal ones in the order
    of their sources, then of the rows' ``ord``."""
    made = [e.select(*scope, "kind", "author", "date", F.lit(i).alias("source"), "ord") for i, e in enumerate(events)]
    w = Window.partitionBy(*scope).orderBy(F.col("date").asc_nulls_last(), "source", "ord")
    return reduce(DataFrame.unionByName, made).withColumn("position", F.row_number().over(w))


# ---- captions and counters


def captions(paragraphs: DataFrame, chain_ids: Column, instruction: Column) -> DataFrame:
    """Paragraphs whose style chain has Caption, with the identifier of their SEQ field."""
    return paragraphs.filter(F.exists(chain_ids, lambda s: F.lower(s) == "caption")).withColumn("seq_id", sequence_id(instruction))


def sequence_id(instruction: Column) -> Column:
    """The identifier of a SEQ field's instruction; null of others."""
    return F.nullif(F.regexp_extract(instruction, r'(?i)^\s*SEQ\s+"?([^\s"\\]+)', 1), F.lit(""))


# ---- included documents


def expand_includes(documents: DataFrame, root_ids: DataFrame, pattern: str = r"\{INCLUDE:([^}]*)\}", most: int = 8) -> DataFrame:
    """(id, text) of the roots, with each reference to a document (id, text) replaced by that document's text.

    Includes nest up to ``most`` deep; one that would come back to a document it is in, that is too deep, or whose document
    is missing is left as it stands. One round a level: the open references are joined to their documents.
    """
    marker = "\x00"
    quoted = re.compile(pattern).pattern
    state = root_ids.select("id").distinct().join(documents, "id").select("id", F.array(F.struct(F.col("text").alias("t"), F.array("id").alias("path"))).alias("parts"))
    for _ in range(most):
        # Each part is cut at its references: even pieces are text, odd ones names.
        flat = state.select("id", F.posexplode("parts").alias("i", "p")).select("id", "i", "p.t", "p.path")
        cut = flat.withColumn("_cut", F.split(F.regexp_replace("t", quoted, marker + "$1" + marker), marker))
        piece = cut.select("id", "i", "path", F.posexplode("_cut").alias("j", "piece"))
        named = piece.withColumn("name", F.when(F.col("j") % 2 == 1, F.col("piece")))
        held = documents.select(F.col("id").cast("string").alias("name"), F.col("id").alias("_into"), F.col("text").alias("_body"))
        joined = named.join(held, "name", "left").withColumn("_ok", F.col("_body").isNotNull() & ~F.array_contains("path", F.col("_into")))
        literal = F.concat(F.lit("{INCLUDE:"), "piece", F.lit("}"))
        shown = F.when(F.col("name").isNull(), F.struct(F.col("piece").alias("t"), F.lit(True).alias("done"), F.col("path")))
        shown = shown.when(F.col("_ok"), F.struct(F.col("_body").alias("t"), F.lit(False).alias("done"), F.concat("path", F.array("_into")).alias("path")))
        shown = shown.otherwise(F.struct(F.regexp_replace(literal, r"^\{INCLUDE:", "{​INCLUDE:").alias("t"), F.lit(True).alias("done"), F.col("path")))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", shown.alias("s")))), lambda x: F.struct(x["s"]["t"].alias("t"), x["s"]["path"].alias("path")))
        state = joined.groupBy("id").agg(parts.alias("parts"), F.bool_or(F.col("_ok")).alias("more")).select("id", "parts", "more")
        if state.filter("more").isEmpty():
            break
        state = state.drop("more")
    body = F.array_join(F.transform(F.col("parts"), lambda p: p["t"]), "")
    return state.select("id", F.replace(body, F.lit("{​INCLUDE:"), F.lit("{INCLUDE:")).alias("text"))


# ---- node transforms


def node_path_under(path: Column, root: Column) -> Column:
    return path.startswith(F.concat(root, F.lit("/")))


def remove_nodes(nodes: DataFrame, scope: list[str], path: str, removed: Column) -> DataFrame:
    """Rows without those removed and all that lies under them: an anti join on the prefixes of each row's path."""
    gone = nodes.filter(removed).select(*scope, F.col(path).alias("_gone")).distinct()
    steps = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    hit = nodes.select(*scope, path, F.explode(prefixes).alias("_gone")).join(gone, [*scope, "_gone"], "left_semi").select(*scope, path).distinct()
    return nodes.join(hit, [*scope, path], "left_anti")


def replace_nodes(nodes: DataFrame, replaced: Column, texts: Column, text: str, name: str = "part") -> DataFrame:
    """A replaced row becomes one row for each text of an array (none for an empty one); ``part`` numbers them from 0."""
    parts = F.when(replaced, texts).otherwise(F.array(F.col(text)))
    return nodes.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias(name, "_new")).withColumn(text, F.col("_new")).drop("_parts", "_new")


def visit_order(nodes: DataFrame, scope: list[str], order: str, part: str) -> DataFrame:
    """Nodes of body, headers, footers and notes (comments aside) with their number in pre-order within their part."""
    return nodes.filter(F.col(part) != "comments").withColumn("ordinal", F.row_number().over(Window.partitionBy(*scope, part).orderBy(order)) - 1)


def collapse_runs(runs: DataFrame, scope: list[str], order: str, text: str, props: Column) -> DataFrame:
    """Neighbouring runs of equal properties as one: (scope, run, first, text, props)."""
    w = Window.partitionBy(*scope).orderBy(order)
    held = runs.withColumn("_p", props)
    held = held.withColumn("_new", F.when(F.col("_p").eqNullSafe(F.lag("_p").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    held = held.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*scope, "run").agg(F.min(order).alias("first"), F.array_join(in_order(F.col(text).cast("string"), F.col(order)), "").alias("text"), F.first("_p").alias("props"))


#: Kinds of leaves that text can stand for.
TEXT_KINDS = {"text": None, "tab": "\t", "break": "\n", "hyphen": "-"}


def text_leaves(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*TEXT_KINDS))


def simplify_paragraphs(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, paragraph, text): each paragraph as one run without properties."""
    return text_leaves(nodes).groupBy(*scope, "paragraph").agg(F.array_join(in_order(F.coalesce("text", F.lit("")), F.col("ord")), "").alias("text"))
