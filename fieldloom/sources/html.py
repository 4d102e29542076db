"""HTML as blocks: decoding of bytes, paragraphs with headings, lists, tables, links, and named anchors as bookmarks.

Nothing is ever fetched; pictures keep their source as text, and only data URIs count as content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS = "doc string, ord int, kind string, level int, text string, href string, bookmark string, row int, cell int"
_CHARSET = re.compile(rb"""(?is)<meta\b[^>]*?charset\s*=\s*['"]?\s*([a-z0-9._-]+)""")
#: Elements that start a block of their own.
_BLOCK = frozenset("p div section article header footer main aside nav ul ol dl dt dd blockquote pre table tr td th h1 h2 h3 h4 h5 h6 li hr address figure figcaption form fieldset".split())
_HIDDEN = frozenset("script style head title template noscript".split())


def decode(content: bytes) -> str:
    """By byte order mark, zeros as UTF-16 has them, the charset the page names, strict UTF-8, else Windows-1252."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(codec, "replace")
    head = content[:256]
    if head[1::2].count(0) > len(head) // 8:
        return content.decode("utf-16-le", "replace")
    if head[::2].count(0) > len(head) // 8:
        return content.decode("utf-16-be", "replace")
    named = _CHARSET.search(content[:4096])
    name = named[1].decode("ascii").lower() if named else "utf-8"
    for codec in ("cp1252" if name == "unicode" else name, "utf-8"):
        try:
            return content.decode(codec)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("cp1252", "replace")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.parts: list[str] = []
        self.kind, self.level, self.href, self.mark = "p", 0, None, None
        self.hidden, self.lists, self.table = 0, [], []
        self.quoted = 0

    def flush(self) -> None:
        raw = "".join(self.parts)
        text = raw if self.kind == "pre" else " ".join(raw.split())
        if text or self.mark:
            row, cell = self.table[-1] if self.table else (None, None)
            kind = "quote" if self.quoted and self.kind == "p" else self.kind
            self.rows.append((kind, self.level, text, self.href, self.mark, row, cell))
        self.parts, self.kind, self.level, self.href, self.mark = [], "p", 0, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
            return
        if tag in _BLOCK:
            self.flush()
        if re.fullmatch("h[1-6]", tag):
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "li":
            self.kind, self.level = ("bullet" if not self.lists or self.lists[-1] == "ul" else "number"), max(0, len(self.lists) - 1)
        elif tag == "pre":
            self.kind = "pre"
        elif tag == "blockquote":
            self.quoted += 1
        elif tag == "table":
            self.table.append((-1, -1))
        elif tag == "tr" and self.table:
            self.table[-1] = (self.table[-1][0] + 1, -1)
        elif tag in ("td", "th") and self.table:
            self.table[-1] = (max(0, self.table[-1][0]), self.table[-1][1] + 1)
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "a":
            self.href = self.href or held.get("href")
        elif tag == "img" and (source := held.get("src") or "").strip().lower().startswith("data:image/"):
            self.flush()
            self.rows.append(("image", 0, held.get("alt") or "", source.strip(), None, None, None))
        if name := held.get("id") or (held.get("name") if tag == "a" else None):
            self.mark = self.mark or name

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCK:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "blockquote":
            self.quoted = max(0, self.quoted - 1)
        elif tag == "table" and self.table:
            self.table.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def blocks_of(text: str) -> list[tuple]:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.rows


def blocks(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """(BLOCKS) of each page, which is text or bytes; null and empty ones give no rows."""
    fields = [part.split(" ")[0] for part in BLOCKS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h in zip(batch.column(0), batch.column(1), strict=True):
                page = h.as_py()
                for i, b in enumerate(blocks_of(decode(page) if isinstance(page, bytes) else page or "")):
                    rows.append((d.as_py(), i, *b))
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    return pages.select(F.col(doc).cast("string").alias("doc"), F.col(html)).mapInArrow(work, BLOCKS)


def blocks_once(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """The same, with equal pages parsed once: distinct contents are parsed, then joined back by their digest."""
    keyed = pages.select(F.col(doc).cast("string").alias("doc"), F.col(html).alias("_html"), F.sha2(F.col(html).cast("binary"), 256).alias("_key"))
    parsed = blocks(keyed.groupBy("_key").agg(F.first("_html").alias("_html")), "_key", "_html").withColumnRenamed("doc", "_key")
    return keyed.select("doc", "_key").join(parsed, "_key").drop("_key")


def paragraphs(found: DataFrame) -> DataFrame:
    """Blocks as the paragraph table that the renderers take."""
    kind = F.col("kind")
    numbered = F.when(kind == "bullet", "•").when(kind == "number", "1.")
    return found.select("doc", "ord", "text", F.when(kind == "heading", F.col("level") + 1).alias("heading"), (kind == "quote").alias("is_quote"), (kind == "pre").alias("is_code"), numbered.alias("marker"), (F.col("level") * 18.0).alias("indent"), F.col("row").isNotNull().alias("in_table"))
