"""Word packages as tables.

A package is one binary row, as ``binaryFile`` gives it. ``scan`` unzips and parses it in the task that reads it and emits
rows of one kind: nodes of all stories in document order, or the rows of a side table (comments, notes, styles, numbering,
properties, relationships, images, bibliography). Everything that looks across rows is left to operators on these tables.
"""

from __future__ import annotations

import base64
import io
import json
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.operators import views

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
V = "{urn:schemas-microsoft-com:vml}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Namespace prefixes whose choices an alternate content may take.
ACCEPTED = frozenset("w14 w15 w16 w16cid w16se wps wpg wpc wpi wp14".split())
#: Elements that only wrap others, in runs or blocks; their content counts as if they weren't there.
WRAPPERS = frozenset("sdt sdtContent customXml smartTag ruby rubyBase rt bdo dir hyperlink fldSimple ins del moveFrom moveTo conflictIns conflictDel".split())
#: Revisions that the accepted, and that the rejected document keeps.
KEPT = {"ins": (True, False), "moveTo": (True, False), "conflictIns": (True, False), "del": (False, True), "moveFrom": (False, True), "conflictDel": (False, True)}
#: Run properties that are on or off, and those with a value.
TOGGLES = ("b", "i", "strike", "dstrike", "caps", "smallCaps", "vanish", "rtl")
VALUES = ("u", "vertAlign", "rStyle", "sz", "color", "highlight", "lang")

NODES = "doc string, part string, story string, path string, depth int, sibling int, ord long, kind string, text string, paragraph long, block int, row int, cell int, keep_accept boolean, keep_reject boolean, props map<string,string>"
TABLES: dict[str, str] = {
    "nodes": NODES,
    "comments": "doc string, id string, author string, initials string, date string, text string, para_id string",
    "comments_ex": "doc string, para_id string, parent_para_id string, done boolean",
    "notes": "doc string, kind string, id string, type string, ord int, text string",
    "styles": "doc string, style_id string, type string, name string, based_on string, is_default boolean, ord int, props map<string,string>",
    "numbering": "doc string, num_id int, abs_id int, ilvl int, fmt string, lvl_text string, start int, style_link string, ord int",
    "properties": "doc string, kind string, name string, value string",
    "relationships": "doc string, part string, id string, type string, target string, external boolean",
    "images": "doc string, part string, id string, data_uri string",
    "bibliography": "doc string, part string, xml string",
}


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, content) of the files under a path or glob."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")


class Package:
    """The parts of one package. What is no package has no parts."""

    def __init__(self, content: bytes | None):
        self.parts: dict[str, bytes] = {}
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                self.parts = {n: z.read(n) for n in z.namelist()}
        except (zipfile.BadZipFile, OSError, RuntimeError, zipfile.zlib.error):
            pass

    def xml(self, name: str | None) -> ET.Element | None:
        if not name or name not in self.parts:
            return None
        try:
            return ET.fromstring(self.parts[name])
        except ET.ParseError:
            return None

    def relationships(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, type, target, external); internal targets are part names."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", f"{name}.rels"))
        out = []
        for r in root if root is not None else ():
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                target = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
            out.append((r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], target, external))
        return out

    def related(self, part: str, kind: str) -> str | None:
        return next((t for _, k, t, external in self.relationships(part) if k == kind and not external), None)

    @property
    def main(self) -> str:
        return self.related("", "officeDocument") or "word/document.xml"


def _on(element: ET.Element | None) -> bool:
    return element is not None and element.get(f"{W}val", "true") not in ("0", "false", "off", "none")


def _val(element: ET.Element | None, name: str, default: str | None = None) -> str | None:
    found = None if element is None else element.find(f"{W}{name}")
    return default if found is None else found.get(f"{W}val", default)


def run_props(pr: ET.Element | None) -> dict[str, str]:
    if pr is None:
        return {}
    out = {k: str(_on(e)).lower() for k in TOGGLES if (e := pr.find(f"{W}{k}")) is not None}
    out |= {k: e.get(f"{W}val") or "" for k in VALUES if (e := pr.find(f"{W}{k}")) is not None}
    fonts = pr.find(f"{W}rFonts")
    if fonts is not None and (font := fonts.get(f"{W}ascii") or fonts.get(f"{W}hAnsi")):
        out["font"] = font
    return out


def paragraph_props(pr: ET.Element | None) -> dict[str, str]:
    if pr is None:
        return {}
    out = {"style": _val(pr, "pStyle"), "jc": _val(pr, "jc"), "outline": _val(pr, "outlineLvl")}
    number = pr.find(f"{W}numPr")
    if number is not None:
        out |= {"num_id": _val(number, "numId"), "ilvl": _val(number, "ilvl", "0")}
    indent = pr.find(f"{W}ind")
    if indent is not None:
        out |= {f"ind_{k}": indent.get(f"{W}{k}") for k in ("left", "right", "hanging", "firstLine")}
        out["ind_left"] = out["ind_left"] or indent.get(f"{W}start")
    spacing = pr.find(f"{W}spacing")
    if spacing is not None:
        out |= {f"space_{k}": spacing.get(f"{W}{k}") for k in ("before", "after", "line")}
    if _on(pr.find(f"{W}contextualSpacing")):
        out["contextual"] = "true"
    borders = pr.find(f"{W}pBdr")
    if borders is not None:
        out["borders"] = json.dumps({e.tag.removeprefix(W): e.get(f"{W}val") for e in borders}, sort_keys=True)
    return {k: v for k, v in out.items() if v is not None}


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _chosen(element: ET.Element) -> ET.Element | None:
    """The first choice whose required prefixes are all accepted, else the fallback."""
    for choice in element.findall(f"{MC}Choice"):
        if set(choice.get("Requires", "").split()) <= ACCEPTED:
            return choice
    return element.find(f"{MC}Fallback")


class _Walk:
    """Emits the nodes of one story in document order."""

    def __init__(self, doc: str, part: str, story: str, rels: dict[str, str], first: int = 0):
        self.doc, self.part, self.story, self.rels = doc, part, story, rels
        self.rows: list[tuple] = []
        self.ord, self.paragraph, self.block = first, None, -1
        self.cell: tuple[int | None, int | None] = (None, None)
        self.keep = (True, True)
        self.href: str | None = None

    def emit(self, kind: str, path: str, text: str | None = None, props: dict | None = None) -> None:
        held = {k: str(v) for k, v in (props or {}).items() if v is not None}
        if self.href is not None and kind in ("text", "tab", "break", "hyphen", "symbol"):
            held["href"] = self.href
        parts = path.split("/")
        self.rows.append((self.doc, self.part, self.story, path, len(parts), int(parts[-1]), self.ord, kind, text, self.paragraph, self.block, *self.cell, *self.keep, held))
        self.ord += 1

    def children(self, parent: ET.Element, path: str) -> None:
        for i, child in enumerate(parent):
            self.node(child, f"{path}/{i}")

    def under(self, name: str, element: ET.Element, path: str) -> None:
        """A wrapper: what it holds is kept as revisions say, and has its link."""
        keep, href = self.keep, self.href
        if name in KEPT:
            a, r = KEPT[name]
            self.keep = (keep[0] and a, keep[1] and r)
            self.emit("revision", path, props={"type": name, "author": element.get(f"{W}author"), "date": element.get(f"{W}date")})
        if name == "hyperlink":
            anchor = element.get(f"{W}anchor")
            self.href = f"#{anchor}" if anchor else self.rels.get(element.get(f"{R}id", ""))
        if name == "fldSimple":
            self.emit("field", path, props={"state": "begin"})
            self.emit("instruction", path, element.get(f"{W}instr", ""))
            self.emit("field", path, props={"state": "separate"})
        self.children(element, path)
        if name == "fldSimple":
            self.emit("field", path, props={"state": "end"})
        self.keep, self.href = keep, href

    def node(self, element: ET.Element, path: str) -> None:
        name = _local(element)
        if element.tag == f"{MC}AlternateContent":
            chosen = _chosen(element)
            if chosen is not None:
                self.children(chosen, path)
        elif name in WRAPPERS:
            self.under(name, element, path)
        elif handler := getattr(self, f"_{name}", None):
            handler(element, path)

    # blocks

    def _p(self, element: ET.Element, path: str) -> None:
        pr = element.find(f"{W}pPr")
        keep, outer = self.keep, self.paragraph
        marks = pr.find(f"{W}rPr") if pr is not None else None
        for m in marks if marks is not None else ():
            if _local(m) in KEPT:
                a, r = KEPT[_local(m)]
                self.keep = (self.keep[0] and a, self.keep[1] and r)
        if self.cell == (None, None):
            self.block += 1
        self.paragraph = self.ord
        self.emit("paragraph", path, props=paragraph_props(pr) | {"para_id": element.get(f"{W14}paraId")})
        self.keep = keep
        self.children(element, path)
        self.paragraph = outer
        section = pr.find(f"{W}sectPr") if pr is not None else None
        if section is not None:
            self._sectPr(section, path)

    def _sectPr(self, element: ET.Element, path: str) -> None:
        refs = {f"{e.tag.removeprefix(W).removesuffix('Reference')}_{e.get(f'{W}type', 'default')}": self.rels.get(e.get(f"{R}id", "")) for e in element if _local(e).endswith("Reference")}
        margin = element.find(f"{W}pgMar")
        self.emit("section", path, props=refs | {"title_page": "true" if _on(element.find(f"{W}titlePg")) else None, "margin_left": None if margin is None else margin.get(f"{W}left")})

    def _tbl(self, element: ET.Element, path: str) -> None:
        outer = self.cell
        if outer == (None, None):
            self.block += 1
        grid = element.find(f"{W}tblGrid")
        pr = element.find(f"{W}tblPr")
        look = pr.find(f"{W}tblLook") if pr is not None else None
        self.emit("table", path, props={"columns": None if grid is None else len(grid), "style": _val(pr, "tblStyle"), "look": None if look is None else look.get(f"{W}val")})
        row = 0
        for i, tr in enumerate(element):
            if _local(tr) != "tr":
                self.node(tr, f"{path}/{i}") if _local(tr) in WRAPPERS else None
                continue
            rp = tr.find(f"{W}trPr")
            self.cell = (row, None)
            self.emit("row", f"{path}/{i}", props={"header": "true" if rp is not None and _on(rp.find(f"{W}tblHeader")) else None})
            for c, tc in enumerate(t for t in tr if _local(t) == "tc"):
                cp = tc.find(f"{W}tcPr")
                merge = cp.find(f"{W}vMerge") if cp is not None else None
                self.cell = (row, c)
                self.emit("cell", f"{path}/{i}/{c}", props={"span": _val(cp, "gridSpan"), "continues": None if merge is None else str(merge.get(f"{W}val", "continue") == "continue").lower()})
                self.children(tc, f"{path}/{i}/{c}")
            row += 1
        self.cell = outer

    # what stands in paragraphs

    def _r(self, element: ET.Element, path: str) -> None:
        props = run_props(element.find(f"{W}rPr"))
        for i, child in enumerate(element):
            name, at = _local(child), f"{path}/{i}"
            if name in ("t", "delText"):
                self.emit("text", at, child.text or "", props)
            elif name == "instrText":
                self.emit("instruction", at, child.text or "")
            elif name == "fldChar":
                self.emit("field", at, props={"state": child.get(f"{W}fldCharType")})
            elif name == "tab":
                self.emit("tab", at, "\t", props)
            elif name in ("br", "cr"):
                self.emit("break", at, "\n", props | {"type": child.get(f"{W}type")})
            elif name == "noBreakHyphen":
                self.emit("hyphen", at, "-", props)
            elif name == "sym":
                self.emit("symbol", at, child.get(f"{W}char"), props | {"font": child.get(f"{W}font")})
            elif name in ("footnoteReference", "endnoteReference", "commentReference"):
                self.emit(name.removesuffix("Reference") + "_reference", at, child.get(f"{W}id"))
            elif name in ("drawing", "pict", "object"):
                self.drawing(child, at)
            elif child.tag == f"{MC}AlternateContent":
                chosen = _chosen(child)
                for k, sub in enumerate(chosen if chosen is not None else ()):
                    self.drawing(sub, f"{at}/{k}") if _local(sub) in ("drawing", "pict", "object") else self.node(sub, f"{at}/{k}")

    def drawing(self, element: ET.Element, path: str) -> None:
        """A picture with its relationship, alternative text, size, crop and rotation; text boxes are stories in place."""
        doc_pr = element.find(f".//{WP}docPr")
        blip, extent, transform, crop = (element.find(f".//{x}") for x in (f"{A}blip", f"{WP}extent", f"{A}xfrm", f"{A}srcRect"))
        image = element.find(f".//{V}imagedata")
        rid = blip.get(f"{R}embed") or blip.get(f"{R}link") if blip is not None else image.get(f"{R}id") if image is not None else None
        alt = (doc_pr.get("descr") or doc_pr.get("title") or doc_pr.get("name")) if doc_pr is not None else None
        props = {"rid": rid, "target": self.rels.get(rid or ""), "alt": " ".join(alt.split()) if alt and alt.strip() else None}
        if extent is not None:
            props |= {"cx": extent.get("cx"), "cy": extent.get("cy")}
        if transform is not None:
            props |= {"rotation": int(transform.get("rot", "0")) // 60_000 % 360, "flip_h": transform.get("flipH"), "flip_v": transform.get("flipV")}
        if crop is not None:
            props |= {f"crop_{k}": max(0, min(100_000, int(crop.get(k, "0")))) for k in "ltrb"}
        if rid is not None or alt:
            self.emit("drawing", path, props=props)
        for k, box in enumerate(element.iter(f"{W}txbxContent")):
            self.emit("text_box", f"{path}/{k}")
            outer = self.paragraph
            self.children(box, f"{path}/{k}")
            self.paragraph = outer

    def _bookmarkStart(self, element: ET.Element, path: str) -> None:
        self.emit("bookmark_start", path, element.get(f"{W}name"), {"id": element.get(f"{W}id")})

    def _bookmarkEnd(self, element: ET.Element, path: str) -> None:
        self.emit("bookmark_end", path, None, {"id": element.get(f"{W}id")})

    def _commentRangeStart(self, element: ET.Element, path: str) -> None:
        self.emit("comment_start", path, element.get(f"{W}id"))

    def _commentRangeEnd(self, element: ET.Element, path: str) -> None:
        self.emit("comment_end", path, element.get(f"{W}id"))


def _plain(element: ET.Element) -> str:
    """The text of an element, paragraphs on lines of their own."""
    lines = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in element.iter(f"{W}p")]
    return "\n".join(lines)


def _targets(pkg: Package, part: str) -> dict[str, str]:
    return {i: t for i, _, t, _ in pkg.relationships(part)}


def _nodes(doc: str, pkg: Package) -> Iterator[tuple]:
    main = pkg.main
    stories: list[tuple[str, str, ET.Element | None]] = []
    root = pkg.xml(main)
    stories.append(("main", main, None if root is None else root.find(f"{W}body")))
    for _, kind, target, external in pkg.relationships(main):
        if kind in ("header", "footer") and not external:
            stories.append((kind, target, pkg.xml(target)))
        elif kind in ("footnotes", "endnotes") and not external:
            notes = pkg.xml(target)
            for note in notes if notes is not None else ():
                if note.get(f"{W}type", "normal") == "normal":
                    stories.append((f"{kind[:-1]}:{note.get(f'{W}id')}", target, note))
    at = 0
    for story, part, element in stories:
        if element is None:
            continue
        walk = _Walk(doc, part, story, _targets(pkg, part), at)
        walk.children(element, "0")
        yield from walk.rows
        at = walk.ord


def _comments(doc: str, pkg: Package) -> Iterator[tuple]:
    root = pkg.xml(pkg.related(pkg.main, "comments"))
    for c in root if root is not None else ():
        last = [p.get(f"{W14}paraId") for p in c.iter(f"{W}p")]
        yield doc, c.get(f"{W}id"), c.get(f"{W}author"), c.get(f"{W}initials"), c.get(f"{W}date"), _plain(c), last[-1] if last else None


def _comments_ex(doc: str, pkg: Package) -> Iterator[tuple]:
    root = pkg.xml(pkg.related(pkg.main, "commentsExtended"))
    for c in root if root is not None else ():
        yield doc, c.get(f"{W15}paraId"), c.get(f"{W15}paraIdParent"), c.get(f"{W15}done") in ("1", "true")


def _notes(doc: str, pkg: Package) -> Iterator[tuple]:
    for kind in ("footnotes", "endnotes"):
        root = pkg.xml(pkg.related(pkg.main, kind))
        for i, n in enumerate(root if root is not None else ()):
            yield doc, kind[:-1], n.get(f"{W}id"), n.get(f"{W}type"), i, _plain(n)


def _styles(doc: str, pkg: Package) -> Iterator[tuple]:
    root = pkg.xml(pkg.related(pkg.main, "styles"))
    if root is None:
        return
    defaults = root.find(f"{W}docDefaults")
    if defaults is not None:
        run, par = (defaults.find(f"{W}{a}/{W}{b}") for a, b in (("rPrDefault", "rPr"), ("pPrDefault", "pPr")))
        yield doc, None, "defaults", None, None, True, -1, run_props(run) | paragraph_props(par)
    for i, s in enumerate(root.findall(f"{W}style")):
        props = paragraph_props(s.find(f"{W}pPr")) | run_props(s.find(f"{W}rPr"))
        yield doc, s.get(f"{W}styleId"), s.get(f"{W}type", "paragraph"), _val(s, "name"), _val(s, "basedOn"), s.get(f"{W}default") in ("1", "true"), i, props


def _numbering(doc: str, pkg: Package) -> Iterator[tuple]:
    root = pkg.xml(pkg.related(pkg.main, "numbering"))
    if root is None:
        return
    abstract = {a.get(f"{W}abstractNumId"): a for a in root.findall(f"{W}abstractNum")}
    at = 0
    for num in root.findall(f"{W}num"):
        ref = _val(num, "abstractNumId")
        a = abstract.get(ref)
        starts = {o.get(f"{W}ilvl"): _val(o, "startOverride") for o in num.findall(f"{W}lvlOverride")}
        levels = a.findall(f"{W}lvl") if a is not None else []
        link = (_val(a, "numStyleLink") or _val(a, "styleLink")) if a is not None else None
        for lv in levels or [None]:
            i = None if lv is None else lv.get(f"{W}ilvl")
            start = starts.get(i) or _val(lv, "start", "1") or "1"
            yield doc, int(num.get(f"{W}numId", "0")), int(ref or -1), None if i is None else int(i), _val(lv, "numFmt"), _val(lv, "lvlText"), int(start), link, at
            at += 1


def _properties(doc: str, pkg: Package) -> Iterator[tuple]:
    for kind, rel in (("core", "core-properties"), ("extended", "extended-properties"), ("custom", "custom-properties")):
        root = pkg.xml(pkg.related("", rel))
        for e in root if root is not None else ():
            name = e.get("name") if kind == "custom" else _local(e)
            yield doc, kind, name, "".join(e.itertext())


def _relationships(doc: str, pkg: Package) -> Iterator[tuple]:
    for part in sorted(n for n in pkg.parts if n.startswith("word/") and n.endswith(".xml") and "_rels" not in n):
        for i, kind, target, external in pkg.relationships(part):
            yield doc, part, i, kind, target, external


#: Content types by ending.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def _images(doc: str, pkg: Package) -> Iterator[tuple]:
    for part in sorted(n for n in pkg.parts if n.startswith("word/") and n.endswith(".xml") and "_rels" not in n):
        for i, kind, target, external in pkg.relationships(part):
            if kind == "image" and not external and target in pkg.parts:
                type_ = IMAGE_TYPES.get(target.rsplit(".", 1)[-1].lower(), "application/octet-stream")
                yield doc, part, i, f"data:{type_};base64,{base64.b64encode(pkg.parts[target]).decode()}"


def _bibliography(doc: str, pkg: Package) -> Iterator[tuple]:
    for name in sorted(pkg.parts):
        if name.startswith("customXml/") and name.endswith(".xml") and b"officeDocument/2006/bibliography" in pkg.parts[name]:
            yield doc, name, pkg.parts[name].decode("utf-8", "replace")


_READERS: dict[str, Callable[[str, Package], Iterator[tuple]]] = {"nodes": _nodes, "comments": _comments, "comments_ex": _comments_ex, "notes": _notes, "styles": _styles, "numbering": _numbering, "properties": _properties, "relationships": _relationships, "images": _images, "bibliography": _bibliography}


def scan(packages: DataFrame, table: str) -> DataFrame:
    """The rows of one table of TABLES of all packages (doc, content). What is no package gives no rows."""
    schema = packages.sparkSession.createDataFrame([], TABLES[table]).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, read = to_arrow_schema(schema), _READERS[table]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(read(doc.as_py(), Package(content.as_py())))
                if rows:
                    columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return packages.select("doc", "content").mapInArrow(work, schema)


def has_revisions(nodes: DataFrame) -> DataFrame:
    """Per document, whether any story has a tracked change."""
    return nodes.groupBy("doc").agg(F.bool_or(~F.col("keep_accept") | ~F.col("keep_reject") | (F.col("kind") == "revision")).alias("has_revisions"))


def fields(nodes: DataFrame) -> DataFrame:
    """Complex and simple fields: (doc, ord, end, instruction, cached, depth), put together from the runs between begin, separate
    and end, over paragraphs if need be. Nested fields stand in braces in the instruction of the outer one."""

    def read(key: tuple, pdf):
        out, stack = [], []
        for o, kind, text, props in pdf.sort_values("ord")[["ord", "kind", "text", "props"]].itertuples(index=False):
            state = dict(props).get("state") if kind == "field" else None
            if state == "begin":
                stack.append([int(o), "", "", False])
            elif state == "separate" and stack:
                stack[-1][3] = True
            elif state == "end" and stack:
                at, instruction, cached, _ = stack.pop()
                out.append((key[0], at, int(o), instruction.strip(), cached, len(stack)))
                if stack:
                    spot = 2 if stack[-1][3] else 1
                    stack[-1][spot] += cached if spot == 2 else "{" + instruction.strip() + "}"
            elif stack and kind == "instruction":
                stack[-1][1] += text or ""
            elif stack and kind in ("text", "tab", "break", "hyphen"):
                stack[-1][2 if stack[-1][3] else 1] += text or ""
        import pandas as pd

        return pd.DataFrame(out, columns=["doc", "ord", "end", "instruction", "cached", "depth"])

    kinds = nodes.filter(F.col("kind").isin("field", "instruction", "text", "tab", "break", "hyphen"))
    return kinds.groupBy("doc").applyInPandas(read, "doc string, ord long, end long, instruction string, cached string, depth int")


def with_results(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with the results (doc, ord, end, text) of fields in their places: what stood between a field's begin and end goes,
    and its text, if it isn't null, stands where it began. Fields without a result keep what they show."""
    spans = results.select("doc", F.col("ord").alias("_from"), F.col("end").alias("_to"), F.col("text").alias("_text"))
    gone = views.contained(spans, nodes.select("doc", "ord"), ["doc"], "_from", "_to", "ord").select("doc", "ord").distinct()
    kept = nodes.join(gone, ["doc", "ord"], "left_anti")
    begin = kept.join(spans.select("doc", F.col("_from").alias("ord"), "_text"), ["doc", "ord"], "left")
    shown = F.col("_text").isNotNull()
    return begin.select(*(F.when(shown, "text").otherwise(F.col(c)).alias(c) if c == "kind" else F.coalesce("_text", c).alias(c) if c == "text" else F.col(c) for c in nodes.columns))
