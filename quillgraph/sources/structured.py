"""Web and office documents as typed blocks and tables (SRC1, SRC2, SRC4).

Bytes come through Spark's own ``binaryFile`` reader, which reaches any store and
splits a folder by files, or from a column such as ``pages.html``.  Parsing is a
walk over one document inside a task; everything behind it (Markdown, CSV,
counts) is column expressions over the ``blocks`` array, without a shuffle.

A block has a kind (title, heading, paragraph, list_item, code or table), a
level, a page (slide or sheet, from 1), the region of a web page it lies in, its
text and, for a table, its rows.

Edge cases: a null or blockless document has no blocks, files without a byte
aren't listed by the reader; a damaged one has
its error as text and the blocks before the damage, in case there are any; a tag
cut off by the end of a page is dropped; unknown suffixes raise, or are left out with ``strict=False``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCKS = "array<struct<kind: string, level: int, page: int, region: string, text: string, rows: array<array<string>>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("page", pa.int32()), ("region", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
WEB, OFFICE, PLAIN = (".html", ".htm"), (".docx", ".pptx", ".xlsx"), (".md", ".txt")

UNREAD = {"script", "style", "template", "noscript", "svg", "iframe", "object", "select", "textarea"}
ENDS_BLOCK = {"p", "div", "article", "section", "main", "nav", "aside", "header", "footer", "ul", "ol", "dl", "dt", "dd", "blockquote", "figure", "figcaption", "form", "fieldset", "address", "hr", "body", "html", "details", "summary"}
REGIONS = {"nav", "aside", "header", "footer", "article", "main"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements without an end tag; they are never on the stack.
EMPTY = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: What an opening tag closes where the page forgot to: the tags, and where the search ends.
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


#: Text before a tag, or a tag of letters and digits alone; what else a page holds is left to HTMLParser.
SIMPLE = re.compile(r"([^<]+)(?=<)|<([a-zA-Z][a-zA-Z0-9]*)>|</([a-zA-Z][a-zA-Z0-9]*)>")
#: Elements whose content some versions of HTMLParser read in another way.
RAW = {"script", "style", "title", "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Start tags that end the text before them.
FLUSHES = ENDS_BLOCK | set(HEADINGS) | {"li", "table", "pre", "title"}
PARAGRAPH, PARAGRAPH_ENDS = {"p"}, {"table", "td", "th"}


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Page(HTMLParser):
    """A web page as blocks, by a stack of its open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.tables: list[list[list[str]]] = []
        #: What had been read of the cell around each open table.
        self.around: list[list[str]] = []
        self.unread = 0

    def feed(self, data: str) -> None:
        """The page's plain beginning token by token, the rest from its first other construct on by the parser."""
        at, step = 0, SIMPLE.match
        while m := step(data, at):
            text, tag, end = m.groups()
            if tag:
                tag = tag.lower()
                if tag in RAW:
                    break
                self.handle_starttag(tag, [])
            elif end:
                self.handle_endtag(end.lower())
            elif not self.unread:
                self.parts.append(unescape(text) if "&" in text else text)
            at = m.end()
        if at < len(data):
            super().feed(data[at:])

    def block(self, kind: str, text: str, level: int = 0, rows: list | None = None) -> None:
        if text or rows:
            region = next((t for t in reversed(self.stack) if t in REGIONS), None)
            self.blocks.append({"kind": kind, "level": level, "page": 1, "region": region, "text": text, "rows": rows})

    def flush(self) -> None:
        """What has been read since the last block ends one; inside a table it goes on."""
        if self.tables:
            self.parts.append(" ")
            return
        if not self.parts:
            return
        text, self.parts = squeezed(self.parts) if "pre" not in self.stack else "".join(self.parts).strip("\n"), []
        kind, level = "paragraph", 0
        for tag in reversed(self.stack):
            if tag in HEADINGS:
                kind, level = "heading", HEADINGS[tag]
            elif tag in ("title", "pre"):
                kind = {"title": "title", "pre": "code"}[tag]
            elif tag == "li":
                kind, level = "list_item", sum(t in ("ul", "ol") for t in self.stack)
            else:
                continue
            break
        self.block(kind, text, level)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append("\n" if "pre" in self.stack else " ")
            return
        if self.unread or tag in EMPTY:
            if tag == "hr":
                self.flush()
            return
        if tag in FLUSHES:
            self.flush()
            self.close_open(PARAGRAPH, PARAGRAPH_ENDS)
        if tag in IMPLIED_ENDS:
            self.close_open(*IMPLIED_ENDS[tag])
        self.stack.append(tag)
        if tag in UNREAD:
            self.unread += 1
        elif tag == "table":
            self.tables.append([])
            self.around.append(self.parts)
            self.parts = []
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        if tag in ("tr", "td", "th") and len(self.tables) == 1:
            self.stray()

    def stray(self) -> None:
        """Text of a table outside its cells, its caption too, stands before it."""
        if self.parts:
            self.block("paragraph", squeezed(self.parts))
            self.parts = []

    def close_open(self, tags: set[str], until: set[str]) -> None:
        at = len(self.stack) - 1
        while at >= 0 and self.stack[at] not in until:
            if self.stack[at] in tags:
                self.close_to(at)
            at -= 1

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack[-1]
            if tag in UNREAD:
                self.unread -= 1
            elif tag in ("td", "th") and self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append(squeezed(self.parts))
                self.parts = []
            elif tag == "table" and self.tables:
                rows = [r for r in self.tables.pop() if any(r)]
                if self.tables:  # a table in a cell is its text
                    self.parts = [*self.around.pop(), " ", *(f"{c} " for r in rows for c in r), *self.parts]
                else:
                    self.stray()
                    self.around.pop()
                    self.stack.pop()
                    self.block("table", "", rows=rows)
                    continue
            elif tag in ENDS_BLOCK or tag in HEADINGS or tag in ("li", "pre", "title"):
                self.flush()
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            self.close_to(len(self.stack) - 1 - self.stack[::-1].index(tag))
        elif tag in ENDS_BLOCK and not self.unread:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.parts.append(data)


def html_blocks(html: str) -> list[dict]:
    page = Page()
    if html.rfind("<") > html.rfind(">"):
        html = html[: html.rfind("<")]
    page.feed(html)
    page.close()
    page.close_to(0)
    page.flush()
    return page.blocks


def plain_blocks(text: str, markdown: bool) -> list[dict]:
    """Paragraphs between blank lines; in Markdown lines of # are headings, and pipes with a rule below a table."""
    found = []
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = part.strip("\n").split("\n")
        heading = re.match(r"(#{1,6})\s+(.*)", lines[0]) if markdown else None
        if heading:
            found.append(_block("heading", heading[2].strip(), len(heading[1])))
            lines = lines[1:]
        if markdown and len(lines) > 1 and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[1]) and "|" in lines[0]:
            cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in [lines[0], *lines[2:]]]
            found.append(_block("table", "", rows=cells))
        elif any(line.strip() for line in lines):
            found.append(_block("paragraph", "\n".join(lines).strip()))
    return found


def _block(kind: str, text: str, level: int = 0, page: int = 1, rows: list | None = None) -> dict:
    return {"kind": kind, "level": level, "page": page, "region": None, "text": text, "rows": rows}


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _all(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in element.iter() if _name(e) == name]


def _attribute(element: ElementTree.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), "")


def _said(element: ElementTree.Element) -> str:
    """Text of runs; tabs and breaks are blanks."""
    return squeezed([(e.text or "") if _name(e) == "t" else " " for e in element.iter() if _name(e) in ("t", "tab", "br", "cr")])


def docx_blocks(parts: zipfile.ZipFile) -> Iterator[dict]:
    body = next(e for e in ElementTree.fromstring(parts.read("word/document.xml")) if _name(e) == "body")

    def walk(element: ElementTree.Element) -> Iterator[dict]:
        for e in element:
            kind = _name(e)
            if kind == "tbl":
                rows = [[" ".join(filter(None, map(_said, _all(c, "p")))) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
                yield _block("table", "", rows=rows)
            elif kind == "p" and (text := _said(e)):
                style = next((_attribute(s, "val") for s in _all(e, "pStyle")), "")
                heading = re.fullmatch(r"[Hh]eading\s*(\d)", style)
                if style.lower() == "title":
                    yield _block("title", text)
                elif heading:
                    yield _block("heading", text, int(heading[1]))
                elif _all(e, "numPr"):
                    yield _block("list_item", text, 1 + int(next((_attribute(s, "val") for s in _all(e, "ilvl")), "0") or 0))
                else:
                    yield _block("paragraph", text)
            elif kind in ("sdt", "sdtContent"):
                yield from walk(e)

    yield from walk(body)


def pptx_blocks(parts: zipfile.ZipFile) -> Iterator[dict]:
    slides = sorted((int(m[1]), n) for n in parts.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for page, (_, name) in enumerate(slides, 1):
        for e in ElementTree.fromstring(parts.read(name)).iter():
            if _name(e) == "tbl":
                yield _block("table", "", page=page, rows=[[_said(c) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"])
            elif _name(e) == "sp":
                title = any(_attribute(p, "type") in ("title", "ctrTitle") for p in _all(e, "ph"))
                for p in _all(e, "p"):
                    if text := _said(p):
                        level = next((int(_attribute(x, "lvl") or 0) for x in _all(p, "pPr")), 0)
                        yield _block("heading", text, 1, page) if title else _block("list_item" if level else "paragraph", text, level, page)


def xlsx_blocks(parts: zipfile.ZipFile) -> Iterator[dict]:
    names = set(parts.namelist())
    shared = [_said(e) for e in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")) if _name(e) == "si"] if "xl/sharedStrings.xml" in names else []
    targets = {_attribute(e, "Id"): _attribute(e, "Target") for e in _all(ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels")), "Relationship")}
    for page, sheet in enumerate(_all(ElementTree.fromstring(parts.read("xl/workbook.xml")), "sheet"), 1):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        rows = []
        for row in _all(ElementTree.fromstring(parts.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")), "row"):
            cells: dict[int, str] = {}
            for c in (e for e in row if _name(e) == "c"):
                letters = re.match("[A-Z]*", _attribute(c, "r"))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                value = next((e.text or "" for e in c if _name(e) == "v"), "")
                kind = _attribute(c, "t")
                text = shared[int(value)] if kind == "s" and value else _said(c) if kind == "inlineStr" else {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value
                cells[(at or len(cells) + 1) - 1] = text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        width = max(map(len, rows), default=0)
        yield _block("heading", _attribute(sheet, "name"), 1, page)
        if width:
            yield _block("table", "", page=page, rows=[r + [""] * (width - len(r)) for r in rows if any(r)])


def blocks_of(suffix: str, content: bytes | None) -> tuple[list[dict], str | None]:
    """(blocks, error) of a document's bytes."""
    found: list[dict] = []
    try:
        if not content:
            return [], None
        if suffix in OFFICE:
            parse = {".docx": docx_blocks, ".pptx": pptx_blocks, ".xlsx": xlsx_blocks}[suffix]
            with zipfile.ZipFile(io.BytesIO(content)) as parts:
                for block in parse(parts):
                    found.append(block)
        elif suffix in WEB:
            found = html_blocks(content.decode("utf-8", "replace"))
        else:
            found = plain_blocks(content.decode("utf-8", "replace"), suffix == ".md")
        return found, None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, StopIteration, RuntimeError, NotImplementedError) as error:
        return found, f"{type(error).__name__}: {error}"


def _blocks_array(documents: list[list[dict]]) -> pa.ListArray:
    """The documents' blocks field by field, as Arrow is slow to take dictionaries apart."""
    flat = [b for blocks in documents for b in blocks]
    ends = pa.array(accumulate((len(blocks) for blocks in documents), initial=0), pa.int32())
    fields = list(_ARROW.value_type)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([b[f.name] for b in flat], f.type) for f in fields], fields=fields), type=_ARROW)


def parse(rows: DataFrame, keep: list[str], content: Column, suffix: Column) -> DataFrame:
    """Columns ``keep`` with blocks and error: every row's document parsed in the task that reads it."""
    keep = [c for c in keep if c not in ("blocks", "error")]
    schema = rows.select(*keep).schema.add("blocks", StructType.fromDDL(f"b {BLOCKS}")["b"].dataType).add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [blocks_of(s, c) for c, s in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)]
                made = [_blocks_array([b for b, _ in found]), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=[*keep, "blocks", "error"])

    return rows.select(*keep, content.cast("binary").alias("__content"), suffix.alias("__suffix")).mapInArrow(run, schema)


def parse_html(rows: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` with the blocks of a column of web pages."""
    return parse(rows, keep, F.col(html_col), F.lit(".html"))


def read_structured(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SRC1: (path, name, blocks, error) of the web, office and text files below ``path``, dot files left out; a missing path raises."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.[A-Za-z0-9]+$", 0))
    name = F.regexp_extract("path", "[^/]+$", 0)
    known = suffix.isin(*WEB, *OFFICE, *PLAIN)
    rows = files.withColumn("name", name).where(~F.col("name").startswith("."))
    rows = rows.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), "name")).cast("boolean") if strict else F.lit(False)))
    return parse(rows, ["path", "name"], F.col("content"), suffix)


def _cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "), F.lit("|"), F.lit("\\|"))


def table_markdown(rows: Column) -> Column:
    """A table's rows as Markdown, the first as its header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, _cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n"))


def table_csv(rows: Column) -> Column:
    """A table's rows as CSV, quoted where a cell needs it."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: quoted(F.coalesce(c, F.lit("")))), ",")), "\n")


def markdown(blocks: Column) -> Column:
    """All blocks as one Markdown text; titles are headings of the first level."""

    def one(b: Column) -> Column:
        head = F.concat(F.repeat(F.lit("#"), F.greatest(b["level"], F.lit(1))), F.lit(" "), b["text"])
        return (
            F.when(b["kind"].isin("title", "heading"), head)
            .when(b["kind"] == "list_item", F.concat(F.repeat(F.lit("  "), F.greatest(b["level"] - 1, F.lit(0))), F.lit("- "), b["text"]))
            .when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .when(b["kind"] == "table", table_markdown(b["rows"]))
            .otherwise(b["text"])
        )

    return F.array_join(F.transform(blocks, one), "\n\n")


def tables(documents: DataFrame, keep: list[str]) -> DataFrame:
    """SRC4: columns ``keep`` with table_no, page, caption, markdown and csv, a row for every table; a caption is the nearest heading before it."""
    at = F.posexplode(F.filter(F.transform("blocks", lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: x["b"]["kind"] == "table")).alias("table_no", "t")
    rows = documents.select(*keep, "blocks", at)
    before = F.filter(F.slice(F.col("blocks"), F.lit(1), F.col("t.i")), lambda b: b["kind"].isin("heading", "title"))
    caption = F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.lit(""))
    return rows.select(*keep, "table_no", F.col("t.b.page").alias("page"), caption.alias("caption"), table_markdown(F.col("t.b.rows")).alias("markdown"), table_csv(F.col("t.b.rows")).alias("csv"))
