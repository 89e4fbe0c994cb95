"""Reading documents and records, and the keep-last upsert of sinks (SRC*, SNK*)."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes a document loader knows; office formats need a parser plug-in.
TEXT_SUFFIXES = (".txt", ".md", ".html")
BINARY_SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx")


def read_documents(spark: SparkSession, path: str, suffixes: Sequence[str] = TEXT_SUFFIXES) -> DataFrame:
    """SRC1-SRC3, SRC15: (path, name, text) of the text files below ``path``, not recursive, dot files left out.

    Undecodable bytes become replacement characters.  Unknown suffixes are not read.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]+$", 0)
    suffix = F.lower(F.regexp_extract("path", "\\.[A-Za-z0-9]+$", 0))
    rows = files.where(suffix.isin(*suffixes) & ~name.startswith("."))
    return rows.select("path", name.alias("name"), decode(F.col("content")).alias("text"))


def decode(content):
    """Bytes as UTF-8, with replacement characters where they are not."""
    return F.make_valid_utf8(content.cast("string"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC11: JSON lines; blank lines are skipped, broken ones give nulls."""
    reader = spark.read.option("mode", "PERMISSIVE")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.limit(limit) if limit is not None else rows


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: (id, question, question_type, answer, evidence) from an array of questions or an object that holds one."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.questions", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = raw.select(F.explode(listed).alias("q"))
    get = lambda p, t="string": F.try_variant_get("q", p, t)
    evidence = F.coalesce(get("$.evidence"), F.array_join(get("$.evidence_chunks", "array<string>"), "; "))
    return each.select(get("$.id").alias("id"), F.coalesce(get("$.question"), get("$.query")).alias("question"), F.coalesce(get("$.question_type"), get("$.query_type")).alias("question_type"), get("$.answer").alias("answer"), evidence.alias("evidence"))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SNK1-SNK4: the last version of each key by ``order``; an aggregation, so versions merge before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*keys, "v.*")


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SNK1: stored rows overlaid by updates; an update wins over a stored row of its key."""
    tagged = existing.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(tagged, keys, ["__new", *order]).drop("__new")


def merge_tables(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """SRC5: rows (page, markdown, ...) of both, primary first, one of each (page, markdown)."""
    both = primary.withColumn("__rank", F.lit(0)).unionByName(secondary.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("page", "markdown")]
    return both.groupBy("page", "markdown").agg(F.min_by(F.struct(*rest), "__rank").alias("v")).select("page", "markdown", "v.*").drop("__rank")


def extract_formulas(markdown):
    """SRC7: LaTeX between $$, \\[ \\] and \\( \\), distinct."""
    found = [F.regexp_extract_all(markdown, F.lit(p), F.lit(1)) for p in ("(?s)\\$\\$(.+?)\\$\\$", "(?s)\\\\\\[(.+?)\\\\\\]", "(?s)\\\\\\((.+?)\\\\\\)")]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.btrim(x, F.lit(" \t\n\r"))))


def augment_markdown(markdown, tables, formulas):
    """SRC8: sections of extracted tables and formulas after the text."""
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(items, "\n\n")))
    return F.concat_ws("\n\n", markdown, section("Extracted Tables", tables), section("Extracted Formulas", F.transform(formulas, lambda f: F.concat(F.lit("$$"), f, F.lit("$$")))))


#: Byte order mark that spreadsheet programs look for.
MARK = "﻿"


def write_jsonl(rows: DataFrame, path: str) -> None:
    """SNK7: JSON lines, nulls left out."""
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK7: CSV files with a header behind a byte order mark, quotes doubled."""
    named = rows.toDF(MARK + rows.columns[0], *rows.columns[1:])
    named.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK7's files again, by position."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)


#: Encodings of dialogue files, in the order they are tried.
ENCODINGS = ("utf-8-sig", "gb18030", "gbk")
#: Letters that text of another encoding turns into.
WRONG_LETTERS = set("ÃÂ\ufffdþýðÉñ¾¿Æçèéåäöü")


def repair_mojibake(text: str) -> str:
    """SRC12: UTF-8 or Chinese text that was read a byte a letter, as it was meant; the reading with the fewest wrong letters wins."""

    def wrong(t: str) -> tuple[int, int]:
        return sum(c in WRONG_LETTERS for c in t) - sum("\u4e00" <= c <= "\u9fff" for c in t), len(t)

    raw = bytearray()
    for c in text:
        try:
            raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return text
    readings = [text]
    for encoding in ("utf-8", "gb18030"):
        try:
            readings.append(bytes(raw).decode(encoding))
        except UnicodeDecodeError:
            continue
    return min(readings, key=wrong)


def read_dialogues(spark: SparkSession, path: str, repair: bool = True) -> DataFrame:
    """SRC12: (path, encoding, row) of all CSV files below ``path``; row maps lower-case column names to text.

    ``repair`` takes back a wrong reading of Chinese text; accented Latin text
    should be read without it.  A file is decoded by the first encoding that fits all of it; each file is
    read by one task, so dialogue files should be of ordinary size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                encoding = next((e for e in ENCODINGS if _decodes(content, e)), "gb18030")
                rows = csv.DictReader(io.StringIO(content.decode(encoding, "replace"), newline=""))
                found = [{(k or "").strip().lower(): repair_mojibake(v or "") if repair else v or "" for k, v in row.items() if not isinstance(v, list)} for row in rows]
                yield pd.DataFrame({"path": name, "encoding": encoding, "row": found})

    return files.mapInPandas(run, "path string, encoding string, row map<string,string>")


def _decodes(content: bytes, encoding: str, step: int = 1 << 20) -> bool:
    """Is the whole of ``content`` text in ``encoding``?  It is decoded in pieces, so nothing of its size is made."""
    decoder = codecs.getincrementaldecoder(encoding)()
    try:
        for at in range(0, len(content), step):
            decoder.decode(content[at : at + step])
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    return True


def split_corpus(text: str, most: int, edge: str | None = None) -> list[str]:
    """SRC13: paragraphs packed up to ``most`` characters; a longer paragraph is cut into pieces.

    Texts and pieces lose the characters ``edge`` at both ends, or all white space without it.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip(edge)
    parts = [p.strip(edge) for p in re.split(r"\n\s*\n", text) if p.strip(edge)]
    if most <= 0 or len(text) <= most or not parts:
        return [text] if text else []
    out: list[str] = []
    held = ""
    for p in parts:
        if held and (len(held) + 2 + len(p) > most or len(p) > most):
            out.append(held)
            held = ""
        if len(p) > most:
            out += [piece for i in range(0, len(p), most) if (piece := p[i : i + most].strip(edge))]
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def read_corpus(spark: SparkSession, path: str, most: int = 0, edge: str | None = None) -> DataFrame:
    """SRC13: (name, segment, text) of a corpus file: one JSON record or a list of records with ``context``; cut and trimmed as :func:`split_corpus` does."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = raw.select(F.posexplode(listed).alias("place", "r")).select(F.coalesce(F.try_variant_get("r", "$.corpus_name", "string"), F.col("place").cast("string")).alias("name"), F.try_variant_get("r", "$.context", "string").alias("context"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, i, t) for n, c in zip(f["name"], f["context"], strict=True) for i, t in enumerate(split_corpus(c or "", most, edge))]
            yield pd.DataFrame(rows, columns=["name", "segment", "text"])

    return rows.mapInPandas(run, "name string, segment int, text string")


def write_markdown(rows: DataFrame, path: str, key: str) -> None:
    """SNK9: one Markdown text per row(``key``, title, text), in a folder of its key."""
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows.select(key, text.alias("value")).repartition(key).write.partitionBy(key).text(path)


#: A Markdown table: a header, a line of dashes, and rows.
MARKDOWN_TABLE = "(?m)(^[ \\t]*\\|.*\\|[ \\t]*\\n[ \\t]*\\|(?:[ \\t]*:?-{2,}:?[ \\t]*\\|)+[ \\t]*(?:\\n[ \\t]*\\|.*\\|[ \\t]*)*)"


def markdown_tables(markdown):
    """SRC4: the tables of a Markdown text, as they stand."""
    return F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(MARKDOWN_TABLE), F.lit(1))


def table_csv(table):
    """SRC4: a Markdown table as CSV lines; cells with a comma or quote are quoted."""
    lines = F.filter(F.split(table, "\n"), lambda x: ~x.rlike("^[ \\t]*\\|(?:[ \\t]*:?-{2,}:?[ \\t]*\\|)+[ \\t]*$"))
    cell = lambda c: F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    row = lambda x: F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), "^\\||\\|$", ""), "\\|"), lambda c: cell(F.trim(c))), ",")
    return F.array_join(F.transform(lines, row), "\n")


def load_result(rows: DataFrame, content_col: str) -> DataFrame:
    """SRC3: ``rows`` with markdown, tables (as CSV) and formulas of decoded bytes; a projection gives the Markdown alone."""
    text = decode(F.col(content_col))
    return rows.withColumn("markdown", text).withColumn("tables", F.transform(markdown_tables(F.col("markdown")), table_csv)).withColumn("formulas", extract_formulas(F.col("markdown")))
