"""Packages, HTML, variable files and included documents, on small inputs made here."""

import io
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldloom import api
from fieldloom.operators import views
from fieldloom.render import docx as write, layout
from fieldloom.sources import database, docx, html, includes, variables
from fieldloom.streaming import merges

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NS = f'xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
BODY = """<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:bookmarkStart w:id="5" w:name="bm"/><w:r><w:t xml:space="preserve">Hello </w:t></w:r><w:ins w:id="1" w:author="A"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>old</w:delText></w:r></w:del><w:bookmarkEnd w:id="5"/><w:hyperlink r:id="rId9"><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>IF 1 = 1 </w:instrText></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>REF x</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>cached</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:smartTag><w:r><w:rPr><w:caps/></w:rPr><w:t> caps</w:t></w:r></w:smartTag></w:p>
<w:p><mc:AlternateContent><mc:Choice Requires="zz"><w:r><w:t>no</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>fallback</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/>"""


def package(body=BODY, **parts):
    held = {
        "[Content_Types].xml": "<Types/>",
        "_rels/.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Type="x/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="rId9" Type="x/hyperlink" Target="http://x/" TargetMode="External"/><Relationship Id="rId2" Type="x/styles" Target="styles.xml"/><Relationship Id="rId3" Type="x/comments" Target="comments.xml"/><Relationship Id="rId4" Type="x/footnotes" Target="footnotes.xml"/><Relationship Id="rId5" Type="x/numbering" Target="numbering.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/comments.xml": f'<w:comments {NS}><w:comment w:id="7" w:author="Me"><w:p w14:paraId="P1"><w:r><w:t>note</w:t></w:r></w:p></w:comment></w:comments>',
        "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="2"><w:p><w:r><w:t>foot</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="4"/></w:num></w:numbering>',
    } | parts
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in held.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def packages(spark):
    return spark.createDataFrame([("d", bytearray(package())), ("bad", bytearray(b"nope")), ("none", None)], "doc string, content binary")


def test_scan(spark, packages):
    nodes = docx.scan(packages, "nodes").cache()
    main = [r for r in nodes.orderBy("ord").collect() if r.story == "main"]
    assert [r.text for r in main if r.kind == "text"] == ["Title", "Hello ", "new", "old", " link", "cached", " caps", "fallback", "a"]
    assert [(r.text, r.keep_accept, r.keep_reject) for r in main if r.text in ("new", "old")] == [("new", True, False), ("old", False, True)]
    assert [r.props["href"] for r in main if r.text == " link"] == ["http://x/"] and [(r.row, r.cell) for r in main if r.text == "a"] == [(0, 0)]
    assert {r.story for r in nodes.collect()} == {"main", "footnote:2"}
    outer = docx.fields(nodes).filter("depth = 0").withColumn("text", F.lit("evaluated"))
    replaced = docx.with_results(nodes, outer).filter("kind = 'text' AND story = 'main'").orderBy("ord").collect()
    assert [r.text for r in replaced][5:8] == ["evaluated", " caps", "fallback"]
    assert [(r.instruction, r.cached, r.depth) for r in docx.fields(nodes).orderBy("ord").collect()] == [("IF 1 = 1 {REF x}", "cached", 0), ("REF x", "", 1)]
    assert [tuple(r) for r in docx.has_revisions(nodes).collect()] == [("d", True)]
    ranges = views.bookmark_ranges(nodes)
    assert [r.body for r in views.bookmark_text(ranges, nodes.filter("kind = 'text' AND keep_accept"), ["doc"], "name", "start", "end", "ord", "text").collect()] == ["Hello new"]
    assert [(r.author, r.text, r.para_id) for r in docx.scan(packages, "comments").collect()] == [("Me", "note", "P1")]
    assert [(r.id, r.type) for r in docx.scan(packages, "notes").orderBy("ord").collect()] == [("0", "separator"), ("2", None)]
    assert [(r.num_id, r.ilvl, r.fmt, r.start) for r in docx.scan(packages, "numbering").collect()] == [(1, 0, "decimal", 3)]
    assert docx.scan(packages.limit(0), "nodes").collect() == [] and docx.scan(packages, "bibliography").collect() == []


def test_renderers(spark, packages):
    text = {r.doc: r.body for r in api.export(packages, "text").collect()}
    assert text == {"d": "Title\n-----\n\nHello new link\n\ncached CAPS\n\nfallback\n\na\n\n"}
    assert "Hello old link" in api.export(packages, "text", accept=False).first().body
    assert api.export(packages, "markdown", plain=True).first().body.startswith("## Title\n\nHello new link\n\n")
    assert '<h2 class="dxp-heading dxp-heading-2">Title</h2>' in api.export(packages, "html").first().body
    assert '<table><tr><td colspan="2">a</td></tr></table>' in api.export(packages, "html").first().body
    assert api.export(packages, "markdown", plain=True).first().body.endswith("| a |\n| --- |\n\n")
    with pytest.raises(ValueError):
        api.format_of("x.pdf")


def test_rebuild_keeps_other_parts():
    first = package(**{"word/media/x.bin": "bytes"})
    once = docx.Package(write.rebuild(first, write.accept_changes))
    assert once.parts["word/media/x.bin"] == b"bytes" and once.parts["word/styles.xml"] == docx.Package(first).parts["word/styles.xml"]
    body = once.parts["word/document.xml"].decode()
    assert "smartTag" not in body and "<w:ins " not in body and "old" not in body and "caps" in body
    assert write.rebuild(first) == write.rebuild(first)


def test_import_of_styles_and_lists():
    style = lambda i, base="": f'<w:style w:type="paragraph" w:styleId="{i}">{base}</w:style>'
    target = ET.fromstring(f"<w:styles {NS}>{style('A')}{style('Same')}</w:styles>")
    source = ET.fromstring(f"""<w:styles {NS}>{style('A', '<w:basedOn w:val="B"/>')}{style('B')}{style('Same')}{style('Other')}</w:styles>""")
    assert write.import_styles(target, source, {"A", "Same"}) == {"A": "A1", "B": "B", "Same": "Same"}
    assert [s.get(f"{{{W}}}styleId") for s in target] == ["A", "Same", "A1", "B"]
    numbering = ET.fromstring(docx.Package(package()).parts["word/numbering.xml"])
    assert write.import_numbering(numbering, numbering, {"1"}) == {"1": "2"}


def test_html():
    assert html.blocks_of("<h1 id=t>Hi &amp; you</h1><p>a <a href=u>b</a><script>x</script><ul><li>one<li>two</ul><table><tr><td>c</table>") == [
        ("heading", 1, "Hi & you", None, "t", None, None), ("p", 0, "a b", "u", None, None, None), ("bullet", 0, "one", None, None, None, None), ("bullet", 0, "two", None, None, None, None), ("p", 0, "c", None, None, 0, 0)]
    page = "<meta charset=iso-8859-1>é"
    assert html.decode(page.encode("latin-1")) == page and html.decode("é".encode()) == "é" and html.decode(b"\xff\xfe" + "é".encode("utf-16-le")) == "é"
    assert html.decode("abc é".encode("utf-16-le")) == "abc é" and html.decode(b"\x80") == "€"


def test_variables_and_sources(spark, tmp_path):
    assert variables.parse_ini("# c\n; c\na = b=c\n\nbad") == {"a": "b=c"} and variables.parse_json('{"a": 1, "b": "x", "c": null}') == {"a": "1", "b": "x", "c": ""}
    assert variables.merged({"A": "1", "b": "2"}, variables.overrides(["a=3", "no"])) == {"b": "2", "a": "3"}
    (tmp_path / "v.ini").write_text("x=1\ny=2")
    assert variables.load(spark, str(tmp_path / "v.ini")) == {"x": "1", "y": "2"}
    chosen = {"Sales": 1, "*": 2}
    assert [database.connection(chosen, n) for n in ("sales", "C:\\db\\Sales.mdb", "/x/other.mdb", None)] == [1, 1, 2, 2]
    with pytest.raises(KeyError):
        database.connection({"a": 1}, "b")
    assert includes.candidates("C:\\share\\docs\\a.docx", ["/in", "/IN"]) == ["/in/share/docs/a.docx", "/in/docs/a.docx", "/in/a.docx"]
    assert includes.candidates("../../etc/passwd", ["/in/x"]) == ["/in/x/etc/passwd", "/in/x/passwd"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_text("<p>x")
    got = includes.load(spark, ["sub/a.html", "\\\\host\\sub\\a.html", "missing"], [str(tmp_path)])
    assert sorted((r.request, r.format, bytes(r.content)) for r in got.collect()) == [("\\\\host\\sub\\a.html", "html", b"<p>x"), ("sub/a.html", "html", b"<p>x")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, k string").parquet(str(tmp_path / "in"))
    out = merges.merge_stream(stream, {"shown": "MERGEFIELD k \\* Upper"})
    q = out.writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.id, r.shown) for r in spark.table("shown").collect()) == [(1, "A"), (2, "B"), (3, "A")]
    q = merges.sequence_stream(stream, ["k"]).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.seq) for r in spark.table("counted").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        merges.merge_stream(stream, {"x": "NEXT"})


def test_layout(spark):
    cut = layout.over_runs(F.lit("abcdefgh"), F.lit(3))
    row = spark.range(1).select(cut.alias("a"), layout.over_runs(F.lit("ab"), F.lit(3)).alias("b"), layout.text_width(F.lit("a il\n"), F.lit(12.0)).alias("c"), layout.tab_stop(F.lit(40.0), F.array(F.lit(30.0), F.lit(50.0))).alias("d"), layout.tab_stop(F.lit(40.0), F.array(F.lit(30.0))).alias("e")).first()
    assert list(row) == [["abc", "def", "gh"], ["a", "b", ""], 12 * (0.5 + 0.33 + 0.5), 50.0, 72.0]


def test_write_files(spark, tmp_path):
    api.write_files(spark.createDataFrame([(1, "a\nb"), (2, "c")], "mergeseq int, body string"), str(tmp_path / "out"))
    assert sorted((r.output, r.value) for r in spark.read.text(str(tmp_path / "out")).collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_ancestors_with_a_circle(spark):
    df = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("d", "x", "gone")], "doc string, id string, up string")
    got = sorted((r.id, r.ancestor, r.level) for r in views.ancestors(df, ["doc"], "id", "up").collect())
    assert got == sorted([("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("b", "a", 2), ("c", "c", 0), ("c", "a", 1), ("c", "b", 2), ("x", "x", 0)])
