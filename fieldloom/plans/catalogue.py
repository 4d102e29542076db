"""Queries of formulas, formats, counters, cells and revisions, each with its SQL. All of them read whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import pictures as P, text as T, words
from fieldloom.functions.formula import formula, formula_text
from fieldloom.operators import cells, counters, merge, revisions, views
from fieldloom.plans.registry import query


@query("customer", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS mergerec, 'Dear ' || c_name AS body FROM customer")
def merge_basic(df):
    return merge.ordered(df.select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "mergerec", T.merge_field(F.col("c_name"), "Dear ").alias("body"))


@query("customer", "SELECT * FROM (SELECT c_custkey, mergerec, row_number() OVER (ORDER BY c_custkey) AS mergeseq FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS mergerec FROM customer) WHERE NOT (c_acctbal < 0))")
def merge_skipif(df):
    return merge.merge_records(df.select("c_custkey", "c_acctbal"), "c_custkey", T.compare(F.col("c_acctbal"), "<", 0)).select("c_custkey", "mergerec", "mergeseq")


@query("nation", "SELECT n_nationkey, n_name, n1 AS n_name_1, n2 AS n_name_2 FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r, lead(n_name) OVER (ORDER BY n_nationkey) AS n1, lead(n_name, 2) OVER (ORDER BY n_nationkey) AS n2 FROM nation) WHERE (r - 1) % 2 = 0")
def merge_next_stride(df):
    return merge.merge_next(df, "n_nationkey", ["n_name"], 2).select("n_nationkey", "n_name", "n_name_1", "n_name_2")


@query("supplier", "SELECT s_suppkey, '<' || s_name || '>' AS framed FROM supplier")
def mergefield_affixes(df):
    return df.select("s_suppkey", T.merge_field(F.col("s_name"), "<", ">").alias("framed"))


@query("orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size_text, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f FROM orders")
def if_compare(df):
    big = T.compare(F.col("o_totalprice"), ">", 100_000)
    return df.select("o_orderkey", F.when(big, "large").otherwise("small").alias("size_text"), F.when(T.compare(F.col("o_orderstatus"), "=", "F"), 1.0).otherwise(0.0).alias("is_f"))


@query("part", "SELECT p_partkey, p_size < 9 AS by_number, p_brand < 'Brand#3' AS by_text FROM part")
def compare_string_vs_number(df):
    return df.select("p_partkey", T.compare(F.col("p_size").cast("string"), "<", "9").alias("by_number"), T.compare(F.col("p_brand"), "<", "Brand#3").alias("by_text"))


@query("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%r_ng'")
def wildcard_filter(df):
    return df.filter(T.compare(F.col("p_name"), "=", "s*r?ng")).select("p_partkey", "p_name")


@query("customer", "SELECT c_custkey, regexp_replace(c_name, '[^0-9.,-]', '', 'g') AS digits FROM customer")
def ref_strip_numeric(df):
    return df.select("c_custkey", T.digits_only(F.col("c_name")).alias("digits"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net, pow(-l_quantity, 2) AS squared, l_quantity / 100 AS share, CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS half FROM lineitem")
def formula_arith(df):
    names = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "qty": F.col("l_quantity")}
    net = formula("price * (1 - discount) * (1 + tax)", names)
    return df.select("l_orderkey", "l_linenumber", net.alias("net"), formula("-qty ^ 2", names).alias("squared"), formula("qty%", names).alias("share"), formula("qty >= 25", names).alias("half"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN '!Zero Divide' ELSE CAST(CAST(floor(l_quantity * l_tax / l_tax * 0 + 7) AS BIGINT) AS VARCHAR) END AS shown, '!Syntax Error' AS broken FROM lineitem")
def formula_div_zero(df):
    return df.select("l_orderkey", "l_linenumber", formula_text("0 * (qty / tax) + 7", {"qty": F.col("l_quantity"), "tax": F.col("l_tax")}).alias("shown"), formula_text("1 +").alias("broken"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, floor(-l_extendedprice) AS int_v, l_quantity % 7 AS mod_v, CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END AS if_v, greatest(l_quantity, 20.0) AS max_v, floor(l_extendedprice + 0.5) AS round_v, CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS and_v FROM lineitem")
def formula_funcs(df):
    names = {"p": F.col("l_extendedprice"), "q": F.col("l_quantity"), "t": F.col("l_tax"), "d": F.col("l_discount")}
    texts = {"int_v": "INT(-p)", "mod_v": "MOD(q, 7)", "if_v": "IF(q > 10, q)", "max_v": "MAX(q, 20)", "round_v": "ROUND(p)", "and_v": "AND(t, d)"}
    return df.select("l_orderkey", "l_linenumber", *(formula(t, names).alias(k) for k, t in texts.items()))


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS v FROM lineitem")
def formula_user_func(df):
    return df.select("l_orderkey", "l_linenumber", formula("Twice(q) + 1", {"q": F.col("l_quantity")}, {"twice": lambda a: a[0] * 2}).alias("v"))


@query("lineitem", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_v, round(avg(l_quantity), 6) AS average_v, count(l_quantity) AS count_v, min(l_quantity) AS min_v, max(l_quantity) AS max_v, min(CAST(l_tax <> 0 AS INT)) AS and_v, max(CAST(l_tax <> 0 AS INT)) AS or_v FROM lineitem GROUP BY l_returnflag")
def agg_functions(df):
    a, b = cells.aggregates(F.col("l_quantity")), cells.aggregates(F.col("l_tax"))
    return df.groupBy("l_returnflag").agg(F.round(a["sum_v"], 2).alias("sum_v"), F.round(a["average_v"], 6).alias("average_v"), *(a[k].alias(k) for k in ("count_v", "min_v", "max_v")), *(b[k].alias(k) for k in ("and_v", "or_v")))


@query("lineitem", "SELECT 0.0::DOUBLE AS sum_v, 1.0::DOUBLE AS product_v, 0.0::DOUBLE AS average_v, 0::BIGINT AS count_v, 0.0::DOUBLE AS min_v, 0.0::DOUBLE AS max_v, 1 AS and_v, 0 AS or_v")
def agg_empty_defaults(df):
    return df.filter("false").agg(*(v.alias(k) for k, v in cells.aggregates(F.col("l_quantity")).items()))


@query("orders", "SELECT o_orderkey, coalesce(round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2), 0) AS above, coalesce(round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2), 0) AS below FROM orders")
def range_above_below(df):
    out = cells.directional(df.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "", "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", F.round("before", 2).alias("above"), F.round("after", 2).alias("below"))


@query("events", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seq FROM events")
def seq_basic(df):
    return counters.sequence(df.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]).select("event_id", "seq")


@query("events", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM events")
def seq_repeat(df):
    return counters.sequence(df, ["user_id"], ["event_id"], repeat=F.col("event_type") == "error").select("event_id", "seq")


@query("events", "SELECT event_id, CAST(CASE WHEN g = 0 THEN row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) ELSE 9 + row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) END AS BIGINT) AS seq FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)")
def seq_reset(df):
    return counters.sequence(df, ["user_id"], ["event_id"], reset=F.when(F.col("event_type") == "signup", 10)).select("event_id", "seq")


@query("orders", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS padded, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE CAST(o_orderkey % 3 AS VARCHAR) || ' items' END AS sections FROM orders")
def num_picture(df):
    k = F.col("o_orderkey")
    return df.select("o_orderkey", P.numeric_picture(F.col("o_totalprice"), "#,##0.00").alias("grouped_raw"), P.numeric_picture(k % 1000, "00000").alias("padded"), P.numeric_picture(k % 3, "0' items';-0' items';none").alias("sections")).withColumn("grouped", F.ltrim("grouped_raw")).drop("grouped_raw")


@query("orders", "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %B %Y') AS long_date, strftime(o_orderdate, '%Y-%m-%d at %H:%M') AS short_date FROM orders")
def date_picture(df):
    return df.select("o_orderkey", P.date_picture(F.col("o_orderdate"), "ddd, dd MMMM yyyy").alias("long_date"), P.date_picture(F.col("o_orderdate"), "yyyy-MM-dd 'at' HH:mm").alias("short_date"))


@query("part", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, upper(p_name[1]) || p_name[2:] AS first_cap, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS caps FROM part")
def text_case(df):
    return df.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), P.first_cap(F.col("p_name")).alias("first_cap"), P.caps(F.col("p_name")).alias("caps"))


_ROMAN = "['','I','II','III','IV','V','VI','VII','VIII','IX'][p_size % 10 + 1]"


@query("part", f"SELECT p_partkey, CASE WHEN p_size > 26 THEN chr(CAST(64 + (p_size - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)) AS alpha, ['','X','XX','XXX','XL','L','LX'][p_size // 10 + 1] || {_ROMAN} AS roman, to_hex(p_size * 1000) AS hex, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM part")
def alpha_roman_hex_ordinal(df):
    n = F.col("p_size")
    return df.select("p_partkey", P.alphabetic(n).alias("alpha"), P.roman(n).alias("roman"), F.hex(F.bround(n.cast("double") * 1000).cast("long")).alias("hex"), P.ordinal(n).alias("ordinal"))


_ONES, _TENS = [f"'{w}'" for w in words.EN_SMALL], [f"'{w}'" for w in words.EN_TENS]


@query("part", f"SELECT p_partkey, CASE WHEN p_size < 20 THEN [{', '.join(_ONES)}][p_size + 1] ELSE [{', '.join(_TENS)}][p_size // 10 - 1] || CASE WHEN p_size % 10 = 0 THEN '' ELSE '-' || [{', '.join(_ONES)}][p_size % 10 + 1] END END AS words FROM part")
def card_words(df):
    return df.select("p_partkey", words.cardinal(F.col("p_size"), "en").alias("words"))


@query("events", "SELECT * FROM (SELECT event_id, user_id FROM events WHERE event_type <> 'error')")
def tracked_accept(df):
    return revisions.accepted(df, revisions.keep_flags(F.col("event_type") == "signup", F.col("event_type") == "error")[0]).select("event_id", "user_id")


@query("events", "SELECT event_id, user_id FROM events WHERE event_type <> 'signup'")
def tracked_reject(df):
    return revisions.rejected(df, revisions.keep_flags(F.col("event_type") == "signup", F.col("event_type") == "error")[1]).select("event_id", "user_id")


_MODE = "CASE event_type WHEN 'signup' THEN 'ins' WHEN 'error' THEN 'del' ELSE '' END"
_W = "OVER (PARTITION BY user_id ORDER BY event_id)"


@query("events", f"SELECT event_id, CASE WHEN m <> '' AND b <> m THEN '<' || m || '>' ELSE '' END || event_type || CASE WHEN m <> '' AND n <> m THEN '</' || m || '>' ELSE '' END AS inline FROM (SELECT *, coalesce(lag(m) {_W}, '') AS b, coalesce(lead(m) {_W}, '') AS n FROM (SELECT *, {_MODE} AS m FROM events))")
def tracked_inline(df):
    accept, reject = revisions.keep_flags(F.col("event_type") == "signup", F.col("event_type") == "error")
    return revisions.inline(df, ["user_id"], "event_id", "event_type", accept, reject).select("event_id", "inline")


@query("events", "SELECT user_id, CASE WHEN a = r THEN a ELSE '<table><tr><td>' || r || '</td><td>' || a || '</td></tr></table>' END AS split FROM (SELECT user_id, coalesce(string_agg(CASE WHEN event_type <> 'error' THEN event_type END, '' ORDER BY event_id), '') AS a, coalesce(string_agg(CASE WHEN event_type <> 'signup' THEN event_type END, '' ORDER BY event_id), '') AS r FROM events GROUP BY user_id)")
def tracked_split(df):
    accept, reject = revisions.keep_flags(F.col("event_type") == "signup", F.col("event_type") == "error")
    return revisions.split(df, ["user_id"], "event_id", "event_type", accept, reject).select("user_id", "split")


@query("events", "SELECT event_id, event_type <> 'error' AS keep_accept, event_type <> 'signup' AS keep_reject, event_type = 'error' AS underline, false AS strike FROM events")
def tracked_by_look(df):
    df = df.select("event_id", F.col("event_type").isin("signup", "error").alias("underline"), (F.col("event_type") == "error").alias("strike"))
    return revisions.classified(df, revisions.by_look(F.col("underline"), F.col("strike"))).select("event_id", "keep_accept", "keep_reject", "underline", "strike")


@query("events", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def section_inherit(df):
    return views.inherited(df, ["user_id"], "event_id", {"header": F.when(F.col("event_type") == "signup", F.col("props"))}).select("event_id", "header")


@query("conversations", "SELECT conv_id, turn, CASE WHEN r = 1 THEN 'firstRow' WHEN r = n THEN 'lastRow' WHEN r % 2 = 0 THEN 'band1Horz' ELSE 'band2Horz' END AS condition FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def table_banding(df):
    return cells.banding(df.select("conv_id", "turn"), ["conv_id"], "turn").select("conv_id", "turn", "condition")


@query("orders", "SELECT o_custkey, string_agg(o_orderkey || chr(9) || o_orderstatus, chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey")
def database_text(df):
    return cells.database_text(df, ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("documents", "SELECT doc_id, length(text) AS n_chars, array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;'), ''), lambda c: CASE WHEN ord(c) BETWEEN 160 AND 255 OR ord(c) > 65535 THEN '&#' || ord(c) || ';' ELSE c END), '') AS html FROM documents")
def html_encode(df):
    return df.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), T.html_text(F.col("text")).alias("html"))
