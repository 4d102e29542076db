"""Queries of document views, renderers and package scans; the driver's tables stand in for documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom import api
from fieldloom.functions import text as T, values as V
from fieldloom.operators import cells, counters, views
from fieldloom.plans.registry import query
from fieldloom.render import docx as render_docx, html, markdown, text
from fieldloom.sources import docx, html as html_source

# ---- chains


_TREE = """WITH RECURSIVE c AS (SELECT conv_id, turn, turn AS up FROM conversations UNION ALL SELECT conv_id, turn, CASE WHEN up % 3 = 0 THEN NULL ELSE up - 1 END FROM c WHERE up IS NOT NULL AND up % 3 <> 0),
r AS (SELECT conv_id, turn, min(up) AS root FROM c JOIN (SELECT conv_id AS k, turn AS t FROM conversations) ON k = conv_id AND t = up GROUP BY ALL)
SELECT conv_id, turn, root AS root_id, root <> turn AS is_reply, CAST(row_number() OVER (PARTITION BY conv_id, root ORDER BY turn % 2, CAST(turn AS VARCHAR)) AS BIGINT) AS position FROM r"""


@query("conversations", _TREE)
def comment_threads(df):
    turn = F.col("turn")
    df = df.select("conv_id", "turn", F.when(turn % 3 != 0, turn - 1).alias("parent"), (turn % 2).alias("date"))
    return views.comment_threads(df, ["conv_id"], "turn", "parent", "date").select("conv_id", "turn", "root_id", "is_reply", F.col("position").cast("long").alias("position"))


@query("conversations", "SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id, turn // 3")
def comment_emit_once(df):
    return views.first_anchors(df.withColumn("root", F.floor(F.col("turn") / 3)), ["conv_id"], "root", "turn").select("conv_id", "turn")


_STYLES = "SELECT 'part' || p_partkey AS id, p_brand AS up, 1 AS lv FROM part UNION ALL SELECT DISTINCT p_brand, 'Maker' || substr(p_brand, 7, 1), 2 FROM part UNION ALL SELECT DISTINCT 'Maker' || substr(p_brand, 7, 1), 'Normal', 3 FROM part UNION ALL SELECT 'Normal', NULL, 4"


def _styles(df):
    part = df.select(F.concat(F.lit("part"), F.col("p_partkey")).alias("style_id"), F.col("p_brand").alias("based_on"), F.col("p_size").alias("size"))
    brand = df.select(F.col("p_brand").alias("style_id"), F.concat(F.lit("Maker"), F.substring("p_brand", 7, 1)).alias("based_on")).distinct().withColumn("size", F.lit(None).cast("int"))
    family = df.select(F.concat(F.lit("Maker"), F.substring("p_brand", 7, 1)).alias("style_id"), F.lit("Normal").alias("based_on")).distinct().withColumn("size", F.substring("style_id", 6, 1).cast("int") * 100)
    base = df.sparkSession.createDataFrame([("Normal", None, 7)], "style_id string, based_on string, size int")
    out = part.union(brand).union(family).union(base)
    props = F.map_filter(F.create_map(F.lit("sz"), F.col("size").cast("string"), F.lit("lang"), F.when(F.col("style_id") == "Normal", "en")), lambda k, v: v.isNotNull())
    return out.select(F.lit("d").alias("doc"), "style_id", F.lit("paragraph").alias("type"), F.col("style_id").alias("name"), "based_on", F.lit(0).alias("ord"), props.alias("props"))


@query("part", f"WITH RECURSIVE s AS ({_STYLES}), c AS (SELECT id AS style_id, id AS ancestor, 0 AS level FROM s UNION ALL SELECT c.style_id, s.up, c.level + 1 FROM c JOIN s ON s.id = c.ancestor WHERE s.up IS NOT NULL) SELECT style_id, ancestor, level FROM c")
def style_chain(df):
    return views.style_chains(_styles(df)).select("style_id", "ancestor", "level")


@query("part", "SELECT 'part' || p_partkey AS style_id, CAST(p_size AS VARCHAR) AS sz, 'en' AS lang FROM part UNION ALL SELECT DISTINCT p_brand, substr(p_brand, 7, 1) || '00', 'en' FROM part")
def style_effective(df):
    """The nearest style of a chain that has a property gives it."""
    chain = views.style_chains(_styles(df)).filter("style_id LIKE 'part%' OR style_id LIKE 'Brand%'")
    out = views.effective(chain, ["style_id"], views.run_precedence(F.lit("paragraph"), F.col("level")), "props", ["sz", "lang"])
    return out.select("style_id", "sz", "lang")


@query("part", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'paragraph' WHEN p_size % 4 = 1 THEN 'character' END AS type FROM part")
def style_pick(df):
    """By id and type, else the first of the id, else none; ids don't depend on case."""
    rows = [("d", "Both", "character", "b", 2), ("d", "Both", "paragraph", "a", 1), ("d", "Only", "character", "c", 3), ("d", "Both", "paragraph", "z", 4)]
    styles = df.sparkSession.createDataFrame(rows, "doc string, style_id string, type string, name string, ord int").withColumn("based_on", F.lit(None).cast("string")).withColumn("props", F.create_map(F.lit("k"), F.lit("v")))
    k = F.col("p_size") % 4
    wanted = df.select("p_partkey", F.lit("d").alias("doc"), F.when(k == 0, "BOTH").when(k == 1, "only").otherwise("none").alias("id"), F.lit("paragraph").alias("kind"))
    return views.pick_styles(wanted, styles, "id", "kind").select("p_partkey", F.col("style.type").alias("type"))


@query("part", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 5 = 1 THEN 1 WHEN p_size % 5 = 2 THEN 4 WHEN p_size % 5 = 3 THEN 2 END AS level, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_size ELSE 8 END AS num_id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'en-US') AS lang FROM part")
def style_look_ups(df):
    k = F.col("p_size")
    names = F.when(k % 5 == 1, F.array(F.lit("x"), F.lit("Title"))).when(k % 5 == 2, F.array(F.lit("heading 3"))).when(k % 5 == 3, F.array(F.lit("Heading1"), F.lit("Title"))).otherwise(F.array(F.lit("Normal")))
    level = views.heading_level(F.when(k % 5 == 0, 1), names)
    number = views.effective_number(F.when(k % 3 == 0, 0).when(k % 3 == 1, k), F.lit(None), F.lit(8), F.lit(1))
    return df.select("p_partkey", level.alias("level"), number["num_id"].alias("num_id"), views.language(F.lit(""), F.when(k % 2 == 0, F.col("p_brand")), F.lit(None), F.lit("en-US")).alias("lang"))


@query("part", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'upperRoman' WHEN p_size % 3 = 1 THEN 'lowerLetter' ELSE 'decimal' END AS fmt FROM part")
def numbering_levels(df):
    """List 1 has levels 0 and 1, list 2 only level 3, list 3 links to a style whose list is 1; other levels fall back."""
    rows = [("d", 1, 0, "decimal", "%1.", 1, None), ("d", 1, 1, "lowerLetter", "%2.", 1, None), ("d", 2, 3, "upperRoman", "%4.", 1, None), ("d", 3, None, None, None, 1, "L")]
    numbering = df.sparkSession.createDataFrame(rows, "doc string, num_id int, ilvl int, fmt string, lvl_text string, start int, style_link string")
    links = df.sparkSession.createDataFrame([("d", "L", 1)], "doc string, style_id string, num_id int")
    k = F.col("p_size") % 3
    wanted = df.select("p_partkey", F.lit("d").alias("doc"), F.when(k == 0, 3).when(k == 1, 1).otherwise(2).alias("num_id"), F.when(k == 1, 1).otherwise(7).alias("ilvl"))
    return views.resolve_levels(wanted, numbering, links).select("p_partkey", F.col("level.fmt").alias("fmt"))


# ---- timeline, bookmarks, sections


_EVENTS = "SELECT o_custkey AS k, 'order' AS kind, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS date, 0 AS source, o_orderkey AS o FROM orders UNION ALL SELECT user_id, event_type, ts, 1, event_id FROM events"


@query("orders events", f"SELECT k, kind, CAST(row_number() OVER (PARTITION BY k ORDER BY date ASC NULLS LAST, source, o) AS BIGINT) AS position FROM ({_EVENTS})")
def timeline_union(orders, events):
    a = orders.select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"), F.lit(None).cast("string").alias("author"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("date"), F.col("o_orderkey").alias("ord"))
    b = events.select(F.col("user_id").alias("k"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("author"), F.col("ts").alias("date"), F.col("event_id").alias("ord"))
    return views.timeline([a, b], ["k"]).select("k", "kind", F.col("position").cast("long").alias("position"))


_RANGES = "SELECT conv_id, 'b' || turn AS name, turn AS s, turn + 3 AS e FROM conversations WHERE turn % 2 = 0"


def _ranges(df):
    return df.filter("turn % 2 = 0").select("conv_id", F.concat(F.lit("b"), F.col("turn")).alias("name"), F.col("turn").alias("s"), (F.col("turn") + 3).alias("e"))


@query("conversations", f"SELECT r.conv_id, r.name, coalesce(string_agg(c.text, '|' ORDER BY c.turn), '') AS body FROM ({_RANGES}) r LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn > r.s AND c.turn < r.e GROUP BY ALL")
def bookmark_text(df):
    """Bookmarks overlap; each has the texts strictly inside."""
    return views.bookmark_text(_ranges(df), df, ["conv_id"], "name", "s", "e", "turn", "text", "|")


@query("conversations", f"SELECT r.conv_id, r.name, arg_min(c.role, c.turn) AS role FROM ({_RANGES}) r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn > r.s AND c.turn < r.e GROUP BY ALL")
def bookmark_first(df):
    return views.first_in_bookmark(_ranges(df), df, ["conv_id"], "name", "s", "e", "turn", "role")


@query("documents labels", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS linked FROM documents d")
def anchors_semi_anti(documents, labels):
    marks = documents.select("doc_id", F.lit("d").alias("doc"), F.concat(F.lit("Doc"), "doc_id").alias("name"))
    links = labels.select(F.lit("d").alias("doc"), F.concat(F.lit("DOC"), "doc_id").alias("name"))
    linked = views.referenced(marks, links, ["doc"], "name").select("doc_id", F.lit(True).alias("linked"))
    return linked.union(views.unreferenced(marks, links, ["doc"], "name").select("doc_id", F.lit(False).alias("linked")))


@query("events", "SELECT event_id, 1 + coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM events")
def section_split(df):
    return views.sections(df, ["user_id"], "event_id", F.col("event_type") == "signup").select("event_id", "section")


@query("events", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'first' WHEN event_type <> 'click' THEN 'default' WHEN event_id % 3 = 0 THEN 'even' WHEN event_type = 'view' THEN 'first' END AS first_page, CASE WHEN event_id % 3 = 0 THEN 'even' WHEN event_type <> 'click' THEN 'default' ELSE 'even' END AS last_page, CAST(NULL AS VARCHAR) AS none FROM events")
def header_select(df):
    default, first = F.when(F.col("event_type") != "click", "default"), F.when(F.col("event_type") == "view", "first")
    made = {n: views.choose_reference(s, F.col("event_id") % 2 == 0, default, first, F.lit("even"), F.col("event_id") % 3 == 0) for n, s in (("first_page", "First"), ("last_page", "Last"), ("none", "None"))}
    return df.select("event_id", *(c.alias(k) for k, c in made.items()))


@query("conversations", "SELECT conv_id, turn, CASE WHEN p = role AND (c OR coalesce(pc, false)) THEN 0.0::DOUBLE ELSE 6.0::DOUBLE END AS space_top, CASE WHEN b IS DISTINCT FROM pb THEN b END AS top_border FROM (SELECT *, lag(role) OVER w AS p, lag(c) OVER w AS pc, lag(b) OVER w AS pb FROM (SELECT *, turn % 3 = 0 AS c, CASE WHEN turn % 4 < 2 THEN 'solid' END AS b FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def paragraph_neighbours(df):
    border = F.when(F.col("turn") % 4 < 2, "solid")
    out = views.neighbours(df, ["conv_id"], "turn", "role", F.col("turn") % 3 == 0, F.lit(6.0), F.lit(6.0), border, border)
    return out.select("conv_id", "turn", "space_top", "top_border")


@query("conversations", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS index FROM conversations WHERE turn % 4 <> 0")
def note_index(df):
    out = counters.note_numbers(df, ["conv_id"], ["turn"], F.when(F.col("turn") % 4 == 0, "separator"))
    return out.select("conv_id", "turn", F.col("index").cast("long").alias("index"))


@query("conversations", "SELECT conv_id, turn, 'Figure' || turn % 3 AS seq_id FROM conversations WHERE role = 'user'")
def captions(df):
    chain = F.array(F.lit("Body"), F.when(F.col("role") == "user", "CAPTION").otherwise("Normal"))
    instruction = F.concat(F.lit(' seq "Figure'), F.col("turn") % 3, F.lit('" \\* ARABIC'))
    return views.captions(df, chain, instruction).select("conv_id", "turn", "seq_id")


# ---- includes and transforms


_MORE = "CASE WHEN n.n_nationkey % 4 <> 3 AND n.n_nationkey < 24 THEN '<' ELSE '' END"
_INCLUDE = f"""WITH RECURSIVE x AS (SELECT n_nationkey AS id, n_name || {_MORE} AS body, n_nationkey AS k FROM nation n
UNION ALL SELECT x.id, x.body || n.n_name || {_MORE}, n.n_nationkey FROM x JOIN nation n ON n.n_nationkey = x.k + 1 WHERE x.k % 4 <> 3 AND x.k < 24)
SELECT id, arg_max(body, k) AS text FROM x GROUP BY id"""


@query("nation", _INCLUDE)
def include_splice(df):
    k = F.col("n_nationkey")
    more = F.when((k % 4 != 3) & (k < 24), F.concat(F.lit("<{INCLUDE:"), k + 1, F.lit("}"))).otherwise("")
    documents = df.select(k.cast("long").alias("id"), F.concat("n_name", more).alias("text"))
    return views.expand_includes(documents, documents)


@query("nation", "SELECT n_nationkey AS id, CASE n_nationkey % 2 WHEN 0 THEN n_name || '+' || coalesce((SELECT n.n_name FROM nation n WHERE n.n_nationkey = m.n_nationkey + 1) || '+{INCLUDE:' || n_nationkey || '}', '{INCLUDE:' || (n_nationkey + 1) || '}') ELSE n_name || '+' || (SELECT n.n_name FROM nation n WHERE n.n_nationkey = m.n_nationkey - 1) || '+{INCLUDE:' || n_nationkey || '}' END AS text FROM nation m")
def include_cycle(df):
    """Each even document includes the next one and the other way round; a circle, and a missing document, is left as it stands."""
    k = F.col("n_nationkey")
    other = F.when(k % 2 == 0, k + 1).otherwise(k - 1)
    documents = df.select(k.cast("long").alias("id"), F.concat("n_name", F.lit("+{INCLUDE:"), other, F.lit("}")).alias("text"))
    return views.expand_includes(documents, documents)


@query("events", "SELECT user_id, first, text FROM (SELECT user_id, min(event_id) AS first, string_agg(event_type || ';', '' ORDER BY event_id) AS text FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, g)")
def run_collapse(df):
    df = df.select("user_id", "event_id", "event_type", F.concat("event_type", F.lit(";")).alias("t"))
    return views.collapse_runs(df, ["user_id"], "event_id", "t", F.col("event_type")).select("user_id", "first", "text")


@query("conversations", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id, turn // 2")
def run_simplify(df):
    kind = F.when(F.col("turn") % 5 == 4, "drawing").otherwise("text")
    nodes = df.select("conv_id", F.floor(F.col("turn") / 2).alias("paragraph"), kind.alias("kind"), "text", F.col("turn").alias("ord"))
    return views.simplify_paragraphs(nodes, ["conv_id"]).select("conv_id", "text")


@query("conversations", "SELECT conv_id, turn, CAST(p AS INT) AS part, CASE WHEN turn % 2 = 1 THEN string_split(text, ' ')[p + 1] ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN turn % 2 = 1 THEN least(2, len(string_split(text, ' '))) ELSE 1 END)) AS p FROM conversations WHERE NOT (turn >= 4 AND turn < 6))")
def node_remove_replace(df):
    """Turns are paths a/b with b under a; node 2 goes with all under it, odd nodes become their first two words."""
    path = F.concat_ws("/", F.lit("0"), F.floor(F.col("turn") / 2), F.col("turn"))
    pairs = df.select("conv_id", "turn", "text", path.alias("path"))
    above = df.filter("turn % 2 = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("0/"), F.floor(F.col("turn") / 2)).alias("path"))
    kept = views.remove_nodes(pairs.union(above), ["conv_id"], "path", F.col("path") == "0/2").filter("turn IS NOT NULL")
    return views.replace_nodes(kept, F.col("turn") % 2 == 1, F.slice(F.split("text", " "), 1, 2), "text").select("conv_id", "turn", F.col("part").cast("int").alias("part"), "text")


@query("conversations", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INT) AS ordinal FROM conversations")
def node_visit_order(df):
    return views.visit_order(df, ["conv_id"], "turn", "role").select("conv_id", "turn", "ordinal")


# ---- tables


@query("lineitem", "SELECT l_orderkey, l_linenumber, CAST(e - s AS INT) AS col, CAST(s AS INT) AS col_span, go AND m > 0 AS is_covered, CAST(CASE WHEN go AND m > 0 THEN 1 ELSE count(*) OVER (PARTITION BY l_orderkey, e - s, m) END AS INT) AS row_span FROM (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey, e - s ORDER BY r) AS m FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS s, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey, r ORDER BY l_linenumber) AS e FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) // 2 AS r, max(l_returnflag) = 'N' AS go FROM lineitem GROUP BY l_orderkey, l_linenumber))) WHERE NOT (go AND m = 0)")
def table_merge_grid(df):
    """Two lines a row, the second twice as wide; lines marked N go on with the cell above. Those with nothing above them
    are left out, as each starts a cell of its own there."""
    df = df.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))  # lines may be repeated
    df = df.select("l_orderkey", "l_linenumber", F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("r"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("s"), (F.col("l_returnflag") == "N").alias("go"))
    first = df.withColumn("top", F.col("go"))
    out = cells.grid(first, ["l_orderkey"], "r", "l_linenumber", "s", "go")
    from pyspark.sql import Window

    down = Window.partitionBy("l_orderkey", "col").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("m", F.sum(F.when(F.col("go"), 0).otherwise(1)).over(down)).filter("NOT (go AND m = 0)")
    return out.select("l_orderkey", "l_linenumber", "col", "col_span", "is_covered", "row_span")


@query("lineitem", "SELECT l_orderkey, CAST(max(n) AS BIGINT) AS columns FROM (SELECT l_orderkey, (l_linenumber - 1) // 2 AS r, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def table_widest(df):
    df = df.select("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("r"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("s"))
    return cells.widest(df, ["l_orderkey"], "r", "s")


@query("lineitem", "SELECT l_orderkey, l_linenumber, 'wholeTable' || CASE WHEN r > 0 THEN CASE WHEN (r - 1) % 2 = 0 THEN ',band1Horz' ELSE ',band2Horz' END ELSE '' END || CASE WHEN c = 0 THEN ',firstCol' ELSE '' END || CASE WHEN r = 0 THEN ',firstRow' ELSE '' END || CASE WHEN r = 0 AND c = 0 THEN ',nwCell' ELSE '' END AS conditions FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) // 2 AS r, (l_linenumber - 1) % 2 AS c FROM lineitem)")
def table_conditions(df):
    n = F.col("l_linenumber") - 1
    out = cells.conditions(df.select("l_orderkey", "l_linenumber", F.floor(n / 2).alias("r"), (n % 2).alias("c")), ["l_orderkey"], "r", "c")
    return out.select("l_orderkey", "l_linenumber", F.array_join("conditions", ",").alias("conditions"))


@query("nation", "WITH c AS (SELECT n_regionkey AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation), w AS (SELECT t, max(length(a)) AS wa, max(length(b)) AS wb FROM c GROUP BY t) SELECT t, string_agg(rpad(a, CAST(wa AS INT), ' ') || ' | ' || rpad(b, CAST(wb AS INT), ' ') || CASE WHEN r = 0 THEN chr(10) || repeat('-', greatest(wa, 3)) || '-+-' || repeat('-', greatest(wb, 3)) ELSE '' END, chr(10) ORDER BY r) AS body FROM c JOIN w USING (t) GROUP BY t")
def ascii_table(df):
    return cells.ascii_table(_nation_cells(df), ["t"], "r", "c", "v")


def _nation_cells(df):
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    both = F.array(F.struct(F.lit(0).alias("c"), F.col("n_nationkey").cast("string").alias("v")), F.struct(F.lit(1).alias("c"), F.concat("n_name", F.lit(" \n ")).alias("v")))
    return df.withColumn("r", row).select(F.col("n_regionkey").alias("t"), "r", F.explode(both).alias("x")).select("t", "r", "x.c", "x.v")


@query("nation", "SELECT n_regionkey AS t, '<table>' || string_agg('<tr><' || tag || ' colspan=\"2\">' || n_name || '</' || tag || '></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'th' ELSE 'td' END AS tag FROM nation) GROUP BY n_regionkey")
def html_table(df):
    g = _nation_cells(df).withColumn("v", F.trim(F.translate("v", "\n", "")))
    g = g.select("t", "r", F.lit(0).alias("c"), "v", (F.col("c") == 0).alias("is_covered"), F.lit(2).alias("col_span"), F.lit(1).alias("row_span"))
    return cells.html_table(g, ["t"], "r", "c", "v", header=F.col("r") == 0)


# ---- renderers


def _paragraphs(df):
    n = F.col("turn")
    return df.select(F.col("conv_id").alias("doc"), n.alias("ord"), F.col("text"), F.when(n == 0, 1).when(n == 1, 2).alias("heading"), (n == 2).alias("is_quote"), (n == 3).alias("is_code"), F.when(n > 3, "1.").alias("marker"), F.when(n == 4, 8.0).otherwise(0.0).alias("indent"))


@query("conversations", "SELECT conv_id AS doc, string_agg(CASE turn WHEN 0 THEN t || chr(10) || repeat('=', greatest(3, length(t))) WHEN 1 THEN t || chr(10) || repeat('-', greatest(3, length(t))) WHEN 2 THEN '> ' || t WHEN 3 THEN '    ' || t WHEN 4 THEN '  1. ' || t ELSE '1. ' || t END || chr(10) || chr(10), '' ORDER BY turn) AS body FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM conversations) GROUP BY conv_id")
def plain_text_render(df):
    return text.document(_paragraphs(df.withColumn("text", F.translate("text", "\n", " "))))


_ENC = "array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;'), ''), lambda c: CASE WHEN ord(c) BETWEEN 160 AND 255 OR ord(c) > 65535 THEN '&#' || ord(c) || ';' ELSE c END), '')"


@query("conversations", f"SELECT conv_id AS doc, string_agg(CASE turn WHEN 0 THEN '# ' || t WHEN 1 THEN '## ' || t WHEN 2 THEN '> ' || t WHEN 3 THEN '```' || chr(10) || t || chr(10) || '```' || chr(10) ELSE '1' || chr(92) || '. ' || t END || chr(10) || chr(10), '' ORDER BY turn) AS body FROM (SELECT *, {_ENC} AS t FROM conversations) GROUP BY conv_id")
def markdown_render(df):
    return markdown.document(_paragraphs(df), markdown.PLAIN)


@query("conversations", f"SELECT conv_id AS doc, string_agg(CASE turn WHEN 0 THEN '<h1>' || t || '</h1>' WHEN 1 THEN '<h2>' || t || '</h2>' WHEN 2 THEN '<blockquote>' || t || '</blockquote>' || chr(10) WHEN 3 THEN '<pre><code>' || t || '</code></pre>' ELSE '1' || chr(92) || '. ' || t END || chr(10) || chr(10), '' ORDER BY turn) AS body FROM (SELECT *, {_ENC} AS t FROM conversations) GROUP BY conv_id")
def markdown_rich(df):
    return markdown.document(_paragraphs(df))


@query("conversations", f"""SELECT conv_id AS doc, '<!DOCTYPE html>' || chr(10) || '<html><head></head><body>' || chr(10) || string_agg(CASE turn WHEN 0 THEN '<h1 class="dxp-heading dxp-heading-1">' || t || '</h1>' WHEN 1 THEN '<h2 class="dxp-heading dxp-heading-2">' || t || '</h2>' WHEN 2 THEN '<blockquote class="dxp-blockquote">' || chr(10) || '<p class="dxp-paragraph">' || t || '</p></blockquote>' WHEN 3 THEN '<pre class="dxp-code"><code>' || t || '</code></pre>' ELSE '<p class="dxp-paragraph"><span class="dxp-marker">1.</span> ' || t || '</p>' END || chr(10), '' ORDER BY turn) || '</body></html>' || chr(10) AS body FROM (SELECT *, {_ENC} AS t FROM conversations) GROUP BY conv_id""")
def html_render(df):
    return html.document(_paragraphs(df), html.PLAIN)


@query("documents", "SELECT doc_id, CASE WHEN length(t) > 80 THEN chr(10) || chr(10) || '```' || chr(10) || t || chr(10) || '```' || chr(10) || chr(10) ELSE chr(10) || chr(10) || '`' || t || '`' || chr(10) || chr(10) END AS echo, (doc_id % 20) || chr(92) || '.' AS marker, '•' AS bullet FROM (SELECT doc_id, 'REF ' || repeat('x', CAST(doc_id % 200 AS BIGINT)) AS t FROM documents WHERE doc_id % 200 > 0)")
def markdown_escape(df):
    k = F.col("doc_id")
    instruction = F.concat(F.lit(" REF "), F.repeat(F.lit("x"), (k % 200).cast("int")))
    return df.filter(k % 200 > 0).select("doc_id", markdown.instruction(instruction).alias("echo"), markdown.marker(F.concat((k % 20).cast("string"), F.lit("."))).alias("marker"), markdown.marker(F.lit('<span style="x">·</span>')).alias("bullet"))


@query("part", "SELECT p_partkey, 'margin-left:' || (p_size * 0.5) || 'pt;margin-top:0pt;text-align:center;border-top:0.5pt solid #000000;' AS css, '<a href=\"#' || p_partkey || '\">x</a>' AS link, 'x (http://h/)' AS plain_link, 'A B' AS alt, '[DRAWING: A B]' AS drawing, '2026-02-07 09:05:06Z' AS utc FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size / 2 AS VARCHAR) END AS half, p_size FROM part) WHERE p_size % 2 = 1")
def html_pieces(df):
    """Odd sizes only, so that half of one has a fraction in both engines' texts."""
    points = V.points(F.col("p_size") * 10)
    css = html.paragraph_css(points, F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit("center"), borders={"top": html.border(F.lit("single"), F.lit(4), F.lit("auto"))})
    href = F.coalesce(F.concat(F.lit("#"), F.col("p_partkey")), F.lit("rel"))
    alt = T.blank_runs(F.lit(" A \n B "))
    return df.filter("p_size % 2 = 1").select("p_partkey", css.alias("css"), markdown.hyperlink(F.lit("x"), href).alias("link"), text.hyperlink(F.lit("x"), F.lit("http://h/")).alias("plain_link"), alt.alias("alt"), html.image(F.lit(None).cast("string"), alt).alias("drawing"), V.utc_text(F.lit("2026-02-07 09:05:06").cast("timestamp")).alias("utc"))


@query("region", """SELECT r_regionkey, '<img src="data:x" alt="' || r_name || '" style="width:10pt;height:20pt;transform:rotate(90deg) scaleX(-1);">' AS framed, '<span style="display:inline-block;position:relative;overflow:hidden;width:10pt;height:20pt;"><img src="data:x" alt="image" style="position:absolute;width:20pt;height:20pt;left:-10pt;top:0pt;"></span>' AS cropped, '[IMAGE]: ' || r_name AS plain FROM region""")
def image_frames(df):
    w, h = V.points(F.lit(127_000), "emu"), V.points(F.lit(400))
    framed = html.image(F.lit("data:x"), F.col("r_name"), w, h, rotation=F.lit(-270), flip_h=F.lit(True))
    cropped = html.image(F.lit("data:x"), F.lit(None).cast("string"), w, h, {"l": F.lit(0.5), "t": F.lit(0.0), "r": F.lit(0.0), "b": F.lit(0.0)})
    return df.select("r_regionkey", framed.alias("framed"), F.replace(cropped, F.lit("top:-0pt"), F.lit("top:0pt")).alias("cropped"), text.image(F.col("r_name")).alias("plain"))


@query("conversations", "SELECT conv_id AS doc, root_id, '[COMMENTS for ' || root_id || ']' || chr(10) || string_agg('  ' || CASE WHEN role = 'user' THEN 'user' ELSE 'Unknown' END || ':' || chr(10) || text || chr(10), chr(10) ORDER BY turn) || chr(10) AS body FROM (SELECT *, turn // 3 * 3 AS root_id FROM conversations) GROUP BY conv_id, root_id")
def comments_render(df):
    n = F.col("turn")
    threads = df.select(F.col("conv_id").alias("doc"), (F.floor(n / 3) * 3).alias("root_id"), n.alias("position"), F.when(F.col("role") == "user", "user").otherwise("").alias("author"), F.lit("").alias("initials"), F.lit(None).cast("string").alias("date"), "text")
    return text.comments(threads).select("doc", "root_id", "body")


@query("nation", "SELECT CAST(n_nationkey AS VARCHAR) AS doc, 'Title: ' || n_name || chr(10) || 'Author: A' || chr(10) || 'Created: 2026-02-07 09:05:06Z' || chr(10) || 'Own: ' || n_regionkey || chr(10) || chr(10) AS header, '<!-- Title: ' || n_name || ' -->' || chr(10) || '<!-- Author: A -->' || chr(10) || '<!-- Created: 2026-02-07 09:05:06Z -->' || chr(10) || '<!-- Own: ' || n_regionkey || ' -->' || chr(10) || chr(10) AS comments FROM nation")
def property_header(df):
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), v.alias("value")) for k, n, v in (("core", "creator", F.lit("A")), ("core", "title", F.col("n_name")), ("core", "subject", F.lit(" ")), ("core", "created", F.lit("2026-02-07T09:05:06Z")), ("custom", "Own", F.col("n_regionkey").cast("string")))))
    properties = df.select(F.col("n_nationkey").cast("string").alias("doc"), F.explode(rows).alias("p")).select("doc", "p.*")
    return text.property_header(properties).join(markdown.property_header(properties).withColumnRenamed("header", "comments"), "doc")


# ---- HTML and packages


@query("pages", None)
def html_blocks(df):
    return html_source.blocks(df, "page_id", "html")


@query("pages", None)
def html_memo(df):
    """Equal pages are parsed once."""
    return html_source.blocks_once(df, "page_id", "html")


@query("documents", "SELECT CAST(doc_id AS VARCHAR) AS doc, replace(replace(replace(text, '&', 'and'), '<', '('), '>', ')') AS body FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND false UNION ALL SELECT CAST(n AS VARCHAR), 'plain ' || n FROM (SELECT doc_id AS n FROM documents)")
def html_round_trip(df):
    pages = df.select("doc_id", F.concat(F.lit("<html><head><title>t</title></head><body><script>x</script> <div>plain&nbsp;"), F.col("doc_id").cast("string"), F.lit("</div></body>")).alias("html"))
    return html_source.blocks(pages, "doc_id", "html").select("doc", F.regexp_replace("text", " ", " ").alias("body"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PARTS = {
    "[Content_Types].xml": "<Types/>",
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Type="x/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f'<w:styles xmlns:w="{_W}"><w:style w:type="paragraph" w:styleId="Sub"><w:name w:val="sub"/><w:basedOn w:val="Heading1"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/media/kept.bin": "kept",
}


def _packages(df, key, title, body):
    """Small packages: a heading, a tracked change, a table of one cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                run = lambda x, tag="t": f'<w:r><w:{tag} xml:space="preserve">{x}</w:{tag}></w:r>'
                xml = f'<w:document xmlns:w="{_W}"><w:body><w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr>{run(t)}</w:p><w:p>{run("now ")}<w:ins w:author="a">{run(b)}</w:ins><w:del w:author="b">{run("old", "delText")}</w:del></w:p><w:p><w:smartTag>{run("tag")}</w:smartTag></w:p></w:body></w:document>'
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, content in {**_PARTS, "word/document.xml": xml}.items():
                        z.writestr(name, content)
                made.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc", "content"])

    return df.select(F.col(key).cast("string").alias("doc"), F.col(title).cast("string"), F.col(body).cast("string")).mapInArrow(work, "doc string, content binary")


@query("supplier", "SELECT CAST(s_suppkey AS VARCHAR) AS doc, s_name || chr(10) || repeat('-', length(s_name)) || chr(10) || chr(10) || 'now ' || s_nationkey || chr(10) || chr(10) || 'tag' || chr(10) || chr(10) AS accepted, s_name || chr(10) || repeat('-', length(s_name)) || chr(10) || chr(10) || 'now old' || chr(10) || chr(10) || 'tag' || chr(10) || chr(10) AS rejected FROM supplier")
def docx_scan(df):
    packages = _packages(df, "s_suppkey", "s_name", "s_nationkey")
    return api.export(packages, "text").withColumnRenamed("body", "accepted").join(api.export(packages, "text", accept=False).withColumnRenamed("body", "rejected"), "doc")


@query("supplier", "SELECT CAST(s_suppkey AS VARCHAR) AS doc, '## ' || s_name || chr(10) || chr(10) || 'now ' || s_nationkey || chr(10) || chr(10) || 'tag' || chr(10) || chr(10) AS body, false AS has_revisions FROM supplier")
def docx_roundtrip(df):
    """Packages with their changes accepted, written back and read again: no change is left, and the text is the accepted one."""
    packages = render_docx.rebuild_all(_packages(df, "s_suppkey", "s_name", "s_nationkey"), render_docx.accept_changes)
    return api.export(packages, "markdown", plain=True).join(docx.has_revisions(docx.scan(packages, "nodes")), "doc")


@query("supplier", "SELECT CAST(s_suppkey AS VARCHAR) AS doc, kind, n FROM supplier, (VALUES ('paragraph', 3), ('text', 5), ('revision', 2)) AS t(kind, n)")
def docx_nodes(df):
    nodes = docx.scan(_packages(df, "s_suppkey", "s_name", "s_nationkey"), "nodes")
    return nodes.groupBy("doc", "kind").agg(F.count("*").cast("int").alias("n"))


