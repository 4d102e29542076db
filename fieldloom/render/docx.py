"""Word packages written back: parts that aren't touched stay as they are, the markup of the others is put in order, and
styles, lists and relationships of another package can be taken over."""

from __future__ import annotations

import copy
import io
import itertools
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.sources.docx import MC, REL, WP, A, Package, R, V, W, W14, W15

for _prefix, _space in (("w", W), ("w14", W14), ("w15", W15), ("r", R), ("mc", MC), ("a", A), ("wp", WP), ("v", V)):
    ET.register_namespace(_prefix, _space[1:-1])

Change = Callable[[str, ET.Element], None]


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {child: parent for parent in root.iter() for child in parent}


def normalise(part: str, root: ET.Element) -> None:
    """Unwraps smart tags, gives drawings ids of their own, numbers pairs of bookmarks anew, moves paragraphs and tables out
    of paragraphs, and wraps runs that stand among blocks."""
    for tag in list(root.iter(f"{W}smartTag")):
        parent = _parents(root).get(tag)
        if parent is not None:
            at = list(parent).index(tag)
            parent.remove(tag)
            for child in reversed([c for c in tag if c.tag != f"{W}smartTagPr"]):
                parent.insert(at, child)
    for i, pr in enumerate(root.iter(f"{WP}docPr"), 1):
        pr.set("id", str(i))
    fresh, open_ids = itertools.count(), {}
    for mark in root.iter():
        if mark.tag == f"{W}bookmarkStart":
            new = str(next(fresh))
            open_ids.setdefault(mark.get(f"{W}id"), []).append(new)
            mark.set(f"{W}id", new)
        elif mark.tag == f"{W}bookmarkEnd" and open_ids.get(mark.get(f"{W}id")):
            mark.set(f"{W}id", open_ids[mark.get(f"{W}id")].pop())
    moved = True
    while moved:
        moved = False
        above = _parents(root)
        for p in list(root.iter(f"{W}p")):
            inner = [c for c in p if c.tag in (f"{W}p", f"{W}tbl")]
            if inner and (parent := above.get(p)) is not None:
                at = list(parent).index(p)
                for k, c in enumerate(inner, 1):
                    p.remove(c)
                    parent.insert(at + k, c)
                moved = True
                break
    for box in [e for e in root.iter() if e.tag in (f"{W}body", f"{W}tc", f"{W}hdr", f"{W}ftr", f"{W}footnote", f"{W}endnote", f"{W}comment")]:
        for i, child in enumerate(list(box)):
            if child.tag == f"{W}r":
                p = ET.Element(f"{W}p")
                p.append(child)
                box[i] = p


def rebuild(content: bytes, change: Change | None = None, parts: dict[str, bytes] | None = None) -> bytes:
    """The package with its stories put in order and changed; all other parts are the same bytes."""
    pkg = Package(content)
    stories = [pkg.main] + [t for _, k, t, external in pkg.relationships(pkg.main) if not external and k in ("header", "footer", "footnotes", "endnotes", "comments")]
    out = dict(pkg.parts) | (parts or {})
    for name in stories:
        root = pkg.xml(name) if name not in (parts or {}) else ET.fromstring((parts or {})[name])
        if root is not None:
            normalise(name, root)
            if change is not None:
                change(name, root)
            out[name] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    return pack(out)


def pack(parts: dict[str, bytes]) -> bytes:
    """A package of parts, the list of content types first."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts, key=lambda n: (n != "[Content_Types].xml", n)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name], zipfile.ZIP_DEFLATED)
    return held.getvalue()


def rebuild_all(packages: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc, content) written back, each package in the task that has it. Null content stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c.as_py() is None else rebuild(c.as_py(), change) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc", "content"])

    return packages.select("doc", "content").mapInArrow(work, "doc string, content binary")


def accept_changes(part: str, root: ET.Element) -> None:
    """Insertions stay, deletions go."""
    _resolve(root, ("ins", "moveTo"), ("del", "moveFrom"))


def reject_changes(part: str, root: ET.Element) -> None:
    _resolve(root, ("del", "moveFrom"), ("ins", "moveTo"))


def _resolve(root: ET.Element, kept: tuple[str, ...], gone: tuple[str, ...]) -> None:
    moved = True
    while moved:
        moved = False
        above = _parents(root)
        for e in root.iter():
            name = e.tag.removeprefix(W)
            parent = above.get(e)
            if parent is None or name not in kept + gone or parent.tag in (f"{W}rPr", f"{W}trPr"):
                continue
            at = list(parent).index(e)
            parent.remove(e)
            if name in kept:
                for child in reversed(list(e)):
                    parent.insert(at, child)
            moved = True
            break
    for t in root.iter(f"{W}delText"):
        t.tag = f"{W}t"


# ---- taking over from another package


def import_styles(target: ET.Element, source: ET.Element, wanted: set[str]) -> dict[str, str]:
    """Adds the wanted styles of ``source``, and those they are based on, linked to or followed by; returns old and new ids. An
    id that the target has already gets a number behind it, unless both styles are the same."""
    have = {s.get(f"{W}styleId"): s for s in target.findall(f"{W}style")}
    theirs = {s.get(f"{W}styleId"): s for s in source.findall(f"{W}style")}
    todo, closure = list(wanted), []
    while todo:
        i = todo.pop()
        if i in theirs and i not in closure:
            closure.append(i)
            todo += [e.get(f"{W}val") for k in ("basedOn", "link", "next") if (e := theirs[i].find(f"{W}{k}")) is not None]
    ids = {}
    for i in closure:
        if i in have and ET.tostring(have[i]) == ET.tostring(theirs[i]):
            ids[i] = i
        else:
            ids[i] = next(n for n in itertools.chain([i], (f"{i}{k}" for k in itertools.count(1))) if n not in have and n not in ids.values())
    for i in closure:
        if ids[i] in have:
            continue
        new = copy.deepcopy(theirs[i])
        new.set(f"{W}styleId", ids[i])
        for k in ("basedOn", "link", "next"):
            e = new.find(f"{W}{k}")
            if e is not None and e.get(f"{W}val") in ids:
                e.set(f"{W}val", ids[e.get(f"{W}val")])
        target.append(new)
    return ids


def import_numbering(target: ET.Element, source: ET.Element, wanted: set[str]) -> dict[str, str]:
    """Adds the wanted lists of ``source`` under new numbers; returns old and new ones."""
    top = lambda tag, key: max((int(e.get(f"{W}{key}", "0")) for e in target.findall(f"{W}{tag}")), default=0)
    abstract, num, ids, seen = top("abstractNum", "abstractNumId"), top("num", "numId"), {}, {}
    theirs = {a.get(f"{W}abstractNumId"): a for a in source.findall(f"{W}abstractNum")}
    for n in source.findall(f"{W}num"):
        old, ref = n.get(f"{W}numId"), n.find(f"{W}abstractNumId")
        if old not in wanted or ref is None or ref.get(f"{W}val") not in theirs:
            continue
        key = ref.get(f"{W}val")
        if key not in seen:
            abstract += 1
            seen[key] = str(abstract)
            new = copy.deepcopy(theirs[key])
            new.set(f"{W}abstractNumId", seen[key])
            target.insert(len(target.findall(f"{W}abstractNum")), new)
        num += 1
        ids[old] = str(num)
        held = copy.deepcopy(n)
        held.set(f"{W}numId", ids[old])
        held.find(f"{W}abstractNumId").set(f"{W}val", seen[key])
        target.append(held)
    return ids


def remap_relationships(blocks: list[ET.Element], source: Package, part: str, parts: dict[str, bytes], rels: ET.Element, folder: str = "word") -> None:
    """Relationships that blocks of another package use are added to the target's, pictures copied, references set anew."""
    theirs = {i: (kind, target, external) for i, kind, target, external in source.relationships(part)}
    raw = source.xml(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
    types = {} if raw is None else {r.get("Id"): r.get("Type") for r in raw}
    taken, made = {r.get("Id") for r in rels}, {}
    for e in itertools.chain.from_iterable(b.iter() for b in blocks):
        for key in (f"{R}id", f"{R}embed", f"{R}link"):
            old = e.get(key)
            if old not in theirs:
                continue
            if old not in made:
                kind, target, external = theirs[old]
                new = next(n for n in (f"rIdX{k}" for k in itertools.count(1)) if n not in taken)
                taken.add(new)
                if not external and target in source.parts:
                    name = next(n for n in (f"{folder}/media/x{k}{posixpath.splitext(target)[1]}" for k in itertools.count(1)) if n not in parts)
                    parts[name] = source.parts[target]
                    target = posixpath.relpath(name, folder)
                entry = ET.SubElement(rels, f"{REL}Relationship", {"Id": new, "Type": types[old], "Target": target})
                if external:
                    entry.set("TargetMode", "External")
                made[old] = new
            e.set(key, made[old])
