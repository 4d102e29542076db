"""URL filters as a temporal join of captures with a dated list (DataFrame and SQL functions only).

A list is a log of dated entries: on a day, a value (a host name with all its subdomains, or a host with a path prefix)
is put on or taken off. ``lead`` over each value's log turns it into validity intervals. A capture is looked up under
every suffix of its host and every prefix of its path, and matches the entries whose interval holds its fetch time, so
a page is judged by the list as it was when the page was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The dated list of op4 (day, kind, value, action, verdict). Domains hold for their subdomains; ``*``
#: stands for each of the top-level domains com, net and org.
LIST = """
2024-01-01 domain cheap-pills.example.* add block
2024-03-01 domain casino-win.example.* add block
2024-02-10 domain free-bets.example.* add block
2024-05-20 domain ads-track.example.* add block
2024-01-15 domain spam-farm.example.* add block
2024-07-01 domain spam-farm.example.* remove block
2024-10-01 domain spam-farm.example.* add block
2024-06-15 domain free-bets.example.* remove block
2024-06-16 domain free-bets.example.* add block
2024-09-01 domain example.net add review
2024-11-15 domain example.net remove review
2024-08-01 prefix cheap-pills.example.com/en add allow
2024-12-01 prefix cheap-pills.example.com/en remove allow
2025-02-01 prefix ads-track.example.org/en add allow
2025-03-01 domain ads-track.example.* remove block
2025-03-01 domain ads-track.example.* add block
2025-04-01 domain casino-win.example.* remove block
2025-04-02 domain casino-win.example.* add block
2025-06-01 domain example.org add review
"""


def list_rows(text: str = LIST) -> list[list[str]]:
    rows = [x.split() for x in text.split("\n") if x]
    return [[*r[:2], r[2].replace("*", top), *r[3:]] for r in rows for top in (("com", "net", "org") if "*" in r[2] else ("",))]


_URL = "^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), "\\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, verdict, valid_from, valid_to) from a log (day, kind, value, action, verdict).

    Of several entries of one value on one day, an ``add`` wins over a ``remove``, then the greatest verdict. The
    interval ends, exclusively, at the value's next entry; the last one is open (null).
    """
    last = Window.partitionBy("kind", "value", "day").orderBy("action", F.col("verdict").desc())
    log = Window.partitionBy("kind", "value").orderBy("day")
    one = entries.filter("day IS NOT NULL AND value IS NOT NULL").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    one = one.withColumn("valid_to", F.lead("day").over(log)).filter("action = 'add'")
    return one.select("kind", "value", "verdict", F.col("day").alias("valid_from"), "valid_to")


def judge_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", broadcast_rows: int = 200_000) -> DataFrame:
    """The captures with verdict, matched_kind, matched_value, valid_from and valid_to.

    The most specific active entry decides: path prefixes before domains, longer values before shorter ones. Captures
    without an active entry, a readable host or a fetch time get the verdict ``none``. The join runs once per distinct
    (url, fetch time), so repeated rows and crowded hosts are gathered before it; the list is broadcast only while it
    has at most ``broadcast_rows`` intervals. Result columns replace columns of the same names.
    """
    active = intervals(entries)
    if active.count() <= broadcast_rows:
        active = F.broadcast(active)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).filter("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    host, path = host_of(F.col("_url")), F.regexp_extract("_url", _PATH, 1)
    labels, parts = F.split(host, "\\."), F.filter(F.split(path, "/"), lambda p: p != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    keys = asked.filter(host != "").select("_url", "_at", F.inline(F.concat(suffixes, prefixes)))
    hit = keys.join(active, ["kind", "value"]).filter("_at >= valid_from AND (valid_to IS NULL OR _at < valid_to)")
    rank = F.struct((F.col("kind") == "prefix").alias("p"), F.length("value").alias("l"), "kind", "value", "verdict", "valid_from", "valid_to")
    best = hit.groupBy("_url", "_at").agg(F.max(rank).alias("_best"))
    found = {"verdict": F.coalesce("_best.verdict", F.lit("none")), "matched_kind": F.col("_best.kind"), "matched_value": F.col("_best.value"), "valid_from": F.col("_best.valid_from"), "valid_to": F.col("_best.valid_to")}
    kept = [c for c in captures.columns if c.lower() not in found]
    joined = captures.select(*kept).join(best, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left")
    return joined.select(*kept, *(c.alias(n) for n, c in found.items()))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table has no capture time; a page's is taken as 2024-01-01 plus 37 * page_id mod 730 days."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched", F.expr("date_add(DATE'2024-01-01', CAST(pmod(pmod(page_id, 730) * 37, 730) AS INT))"))
    rows = ", ".join("(DATE'{}', '{}', '{}', '{}', '{}')".format(*x) for x in list_rows())
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t(day, kind, value, action, verdict)")
    return judge_urls(pages, entries)


OP4_SQL = (
    "WITH log(day, kind, value, action, verdict) AS (VALUES "
    + ", ".join("(DATE '{}', '{}', '{}', '{}', '{}')".format(*x) for x in list_rows())
    + r"""),
one AS (SELECT *, row_number() OVER (PARTITION BY kind, value, day ORDER BY action, verdict DESC) AS n FROM log),
spans AS (SELECT kind, value, verdict, action, day AS valid_from, lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS valid_to FROM one WHERE n = 1),
cap AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 730) * 37 % 730 + 730) % 730 AS INTEGER) AS DATE) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)) AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
keys AS (SELECT page_id, fetched, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS value FROM cap, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)
  UNION ALL SELECT page_id, fetched, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM cap, unnest(range(1, len(parts) + 1)) AS t(i)),
hit AS (SELECT k.page_id, s.*, row_number() OVER (PARTITION BY k.page_id ORDER BY s.kind = 'prefix' DESC, length(s.value) DESC) AS n
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.value = s.value AND s.action = 'add' AND k.fetched >= s.valid_from AND (s.valid_to IS NULL OR k.fetched < s.valid_to))
SELECT c.page_id, c.url, c.fetched, coalesce(h.verdict, 'none') AS verdict, h.kind AS matched_kind, h.value AS matched_value, h.valid_from, h.valid_to
FROM cap c LEFT JOIN hit h ON c.page_id = h.page_id AND h.n = 1"""
)
