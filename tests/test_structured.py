"""Web and office documents: golden cases, damaged files, and all pages against a parser of another kind."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import structured as W


def short(blocks):
    return [(b["kind"], b["level"], b["region"], b["text"] if b["kind"] != "table" else b["rows"]) for b in blocks]


def test_html_blocks_of_a_careless_page():
    page = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var a="</p><p>no";</script></head>
    <body><nav><ul><li>one<li>two <b>bold</b><ul><li>deep</ul></ul></nav><!-- <p>no</p> -->
    <article><h2>Part
    one</h2>loose text<p>first<br>line<p>second <i>para</i></div>after<pre>x = 1
  y</pre><table><caption>c</caption><tr><th>n<th>v<tr><td>1<td>a|b <table><tr><td>inner</table><tr></tr></table>
    <p>caf&eacute; &lt;tag&gt; &copy;</article><footer>end</footer><p"""
    assert short(W.html_blocks(page)) == [
        ("title", 0, None, "A & B"),
        ("list_item", 1, "nav", "one"),
        ("list_item", 1, "nav", "two bold"),
        ("list_item", 2, "nav", "deep"),
        ("heading", 2, "article", "Part one"),
        ("paragraph", 0, "article", "loose text"),
        ("paragraph", 0, "article", "first line"),
        ("paragraph", 0, "article", "second para"),
        ("paragraph", 0, "article", "after"),
        ("code", 0, "article", "x = 1\n  y"),
        ("paragraph", 0, "article", "c"),
        ("table", 0, "article", [["n", "v"], ["1", "a|b inner"]]),
        ("paragraph", 0, "article", "café <tag> ©"),
        ("paragraph", 0, "footer", "end"),
    ]
    assert W.html_blocks("") == [] and W.html_blocks("<p></p><br>") == []
    assert short(W.html_blocks("just text")) == [("paragraph", 0, None, "just text")]
    assert short(W.html_blocks("</div></p>x<script>never closed <p>no")) == [("paragraph", 0, None, "x")]
    deep = "<div>" * 3000 + "bottom" + "</div>" * 3000
    assert short(W.html_blocks(deep)) == [("paragraph", 0, None, "bottom")]


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda text, style="", extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr><w:r><w:t>{text[:3]}</w:t></w:r><w:r><w:t>{text[3:]}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Report", "Title") + p("Methods", "Heading2") + p("Plain &amp; simple") + p("point", "", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr>') + f"<w:tbl><w:tr>{cell('name')}{cell('dose')}</w:tr><w:tr>{cell('aspirin')}{cell('5 mg')}</w:tr></w:tbl>" + p("") + p("last")
    return packed({"word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})


def pptx():
    slide = lambda title, text: f'<p:sld xmlns:p="p" xmlns:a="{DRAW}"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>{text}</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:t>sub</a:t></a:r></a:p></p:sp><a:tbl><a:tr><a:tc><a:t>x</a:t></a:tc></a:tr></a:tbl></p:sld>'
    return packed({"ppt/slides/slide10.xml": slide("Last", "z"), "ppt/slides/slide2.xml": slide("First", "a"), "ppt/notes.xml": "<x/>"})


def xlsx():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in, line</t></is></c></row><row r="3"><c r="B3"><v>4.5</v></c><c r="AA3" t="b"><v>1</v></c></row>'
    return packed(
        {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Doses" sheetId="1" r:id="rId7"/><sheet name="Empty" sheetId="2" r:id="rId8"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>na</t><r><t>me</t></r></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
        }
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("office")
    files = {"a.docx": docx(), "b.pptx": pptx(), "c.xlsx": xlsx(), "d.md": b"# Top\ntext\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "e.txt": "café \xff".encode("latin-1"), "f.html": b"<h1>T</h1><p>x", "g.docx": b"no zip", "h.docx": docx()[:200], "i.txt": b"", "j.xlsx": packed({"x": "y"}), ".hidden.txt": b"no"}
    for name, content in files.items():
        (path / name).write_bytes(content)
    return path


def test_a_folder_of_office_files(spark, folder):
    rows = {r["name"]: r for r in W.read_structured(spark, str(folder)).withColumn("md", W.markdown(F.col("blocks"))).collect()}
    assert len(rows) == 9
    assert [(b["kind"], b["level"], b["text"]) for b in rows["a.docx"]["blocks"]] == [("title", 0, "Report"), ("heading", 2, "Methods"), ("paragraph", 0, "Plain & simple"), ("list_item", 2, "point"), ("table", 0, ""), ("paragraph", 0, "last")]
    assert rows["a.docx"]["md"] == "# Report\n\n## Methods\n\nPlain & simple\n\n  - point\n\n| name | dose |\n| --- | --- |\n| aspirin | 5 mg |\n\nlast"
    assert [(b["page"], b["kind"], b["text"]) for b in rows["b.pptx"]["blocks"]] == [(n, k, t) for n, x in ((1, ("First", "a")), (2, ("Last", "z"))) for k, t in (("heading", x[0]), ("paragraph", x[1]), ("list_item", "sub"), ("table", ""))]
    cells = rows["c.xlsx"]["blocks"][1]["rows"]
    assert cells[0][:3] == ["name", "", "in, line"] and cells[1][1] == "4.5" and cells[1][26] == "TRUE" and [b["text"] for b in rows["c.xlsx"]["blocks"] if b["kind"] == "heading"] == ["Doses", "Empty"]
    assert [b["kind"] for b in rows["d.md"]["blocks"]] == ["heading", "paragraph", "table"] and rows["e.txt"]["blocks"][0]["text"].startswith("caf")
    assert all(rows[n]["blocks"] == [] and rows[n]["error"] for n in ("g.docx", "h.docx", "j.xlsx"))


def test_tables_have_captions_markdown_and_csv(spark, folder):
    got = {(r["name"], r["table_no"]): r for r in W.tables(W.read_structured(spark, str(folder)), ["name"]).collect()}
    assert (got["a.docx", 0]["caption"], got["a.docx", 0]["csv"]) == ("Methods", "name,dose\naspirin,5 mg")
    assert (got["b.pptx", 1]["caption"], got["b.pptx", 1]["page"]) == ("Last", 2)
    assert got["c.xlsx", 0]["csv"].startswith('name,,"in, line",')
    assert got["d.md", 0]["markdown"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_unknown_suffixes_raise_or_are_left_out(spark, folder, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="unsupported format: x.pdf"):
        W.read_structured(spark, str(tmp_path)).collect()
    assert W.read_structured(spark, str(tmp_path), strict=False).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        W.read_structured(spark, str(tmp_path / "none")).collect()


def test_pages_with_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (None, "<p>a", "x", "y"), (2, "<p>b" * 50_000, "x", "y")], "page_id long, html string, blocks string, error string")
    got = sorted(((r.page_id or 0), len(r.blocks)) for r in W.parse_html(pages, ["page_id", "blocks"]).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 50_000)]


def test_every_page_holds_the_words_outside_its_tags(spark, sf):
    for r in W.parse_html(spark.read.parquet(f"{sf}/pages.parquet"), ["html"]).collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style).*?</\1>|<[^>]*>|<[^>]*$", " ", r.html)
        words = re.sub(r"&(\w+);?", lambda m: {"amp": "&", "copy": "©", "middot": "·", "quot": '"'}.get(m[1], m[0]), bare).split()
        assert "".join(words) == "".join(" ".join(b["text"] for b in r.blocks).split())


def test_plain_pages_leave_the_parser_alone(monkeypatch):
    """Tags without attributes are read by one pattern; what follows the first other construct is HTMLParser's."""
    base = W.HTMLParser
    pages = ["<h2>a &amp; b</h2><p>of<table><tr><td>1<td>x, <b>y</b></td></tr></table>", "<P>one<ul><li>two</UL>three</p>&lt;tail", "<title>t</title><p>x", "<p>a < b &am<b>p</b><br/>c", "<p>x<script>if (a<b) {}</script>y<!-- c --><td>z", "<svg><p>no</p></svg><pre> a\n b</pre>"]
    fast = [W.html_blocks(p) for p in pages]
    seen = []
    monkeypatch.setattr(base, "goahead", lambda self, end, old=base.goahead: (seen.append(self.rawdata), old(self, end))[1])
    assert W.html_blocks(pages[0] + "<p>end</p>") and not any(seen)
    monkeypatch.setattr(W.Page, "feed", base.feed)
    assert fast == [W.html_blocks(p) for p in pages]


def pages_against_their_sql(spark, tmp_path, name):
    import duckdb
    from quillgraph.plans import registry

    said = ["x &quot", "x &quot;y&quot;", "x &amp y", "x &ampy &ampquot;", "x &amp;quot; &amp;amp", "x &copy &middot &copy; &middot;", "x &", "x &a", "x &lt; &lt &#39;", None]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, s and f"<html><head><title>{s}</title></head><body><h1>{s}</h1><p>{s}<ul><li>{s}</li></ul></body></html>") for i, s in enumerate(said)])
    con.execute(f"copy pages to '{tmp_path}/pages.parquet' (format parquet)")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in registry.queries()[name](spark, str(tmp_path)).select(*columns).collect())


def test_web_pages_read_references_as_their_sql(spark, tmp_path):
    pages_against_their_sql(spark, tmp_path, "src1_web_pages")


def test_page_markdown_reads_references_as_its_sql(spark, tmp_path):
    pages_against_their_sql(spark, tmp_path, "src3_page_markdown")
