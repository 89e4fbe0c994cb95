"""Chunkers (C1-C5, SRC9, W9, W10, W15): one packing rule, fed with paragraphs, sentences, blocks or lines.

Packing is a fold with resets, so a text is packed inside one Python call; texts
are independent and stream through ``mapInPandas`` in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*$")
SECTION = re.compile(r"#{2,3}\s+(.+)$")
ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
SENTENCE_END = re.compile(r"(?<=[.!?])(\s+)")


def pack(units: Iterable[str], limit: int, glue: str = "", overlap: int = 0, split: Callable[[str], Iterable[str]] | None = None) -> Iterator[str]:
    """Join neighbours while they fit into ``limit``; a chunk starts with the last ``overlap`` characters of the one before.

    A unit that is too long for an empty chunk goes through ``split`` (or stands alone).
    """
    held = ""
    for unit in units:
        if len(held) + len(unit) + len(glue) <= limit:
            held = held + glue + unit if held else unit
        elif held:
            yield held
            held = held[-overlap:] + glue + unit if overlap > 0 else unit
        else:
            yield from split(unit) if split else (unit,)
    if held:
        yield held


def sentence_units(text: str) -> list[str]:
    """Sentences with the blanks that follow them."""
    parts = SENTENCE_END.split(text)
    return [a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=False) if a + b]


def sections(text: str) -> list[tuple[str, str]]:
    """(title, content) at second and third level headings; the title of a text before any is empty."""
    found: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        m = SECTION.match(line)
        if m:
            found.append((m[1].strip(), []))
        else:
            found[-1][1].append(line)
    return [(title, "\n".join(lines)) for title, lines in found if lines] or [("", text)]


def chunk_text(text: str, size: int = 1000, overlap: int = 200) -> list[dict]:
    """Sections, then paragraphs packed to ``size``, long ones by sentences; a section that is only a table stays whole."""
    out = []
    for title, body in sections(text) if text.strip() else []:
        lines = [x.strip() for x in body.split("\n")]
        if not body.strip():
            continue
        if all(not x or x.startswith("|") for x in lines):
            pieces: Iterable[str] = (body,)
        else:
            paragraphs = [p.strip() for p in body.split("\n\n") if p.strip()]
            pieces = pack(paragraphs, size, "\n\n", overlap, lambda p: pack(sentence_units(p), size, "", overlap))
        out += [{"content": p, "section": title} for p in pieces]
    return [c | {"chunk_index": i, "chunk_id": hashlib.md5(c["content"].encode()).hexdigest()[:8]} for i, c in enumerate(out)]


@dataclass
class Block:
    kind: str
    text: str
    path: list[str] = field(default_factory=list)


def _kind(line: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    if HEADING.match(line):
        return "heading"
    if bare.startswith("```"):
        return "fence"
    if bare.startswith("|"):
        return "table"
    return "list" if ITEM.match(line) else "paragraph"


def blocks(markdown: str, short_list: int = 3) -> list[Block]:
    """SRC9: typed blocks with the headings above them; lists of more than ``short_list`` items come item by item."""
    out: list[Block] = []
    path: list[str] = []
    run: list[str] = []
    state = "blank"

    def close() -> None:
        text = "\n".join(run).strip()
        if text and state == "list" and len(run) > short_list:
            out.extend(Block("list_item", item.strip(), path[:]) for item in run)
        elif text:
            out.append(Block("code" if state == "fence" else state, text, path[:]))
        run.clear()

    for line in markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if state == "fence":
            run.append(line)
            if line.strip().startswith("```"):
                close()
                state = "blank"
            continue
        kind = _kind(line)
        if kind != state:
            close()
        if kind == "heading":
            m = HEADING.match(line)
            path = [*path[: len(m[1]) - 1], m[2]]
        elif kind != "blank":
            run.append(line)
        state = kind
    close()
    return out


def parent_groups(items: list[Block], target: int = 4000) -> list[list[Block]]:
    """Neighbours up to ``target`` characters; a new section also starts a group that is half full."""
    groups: list[list[Block]] = []
    size = 0
    for b in items:
        n = len(b.text.strip())
        if not n:
            continue
        other = bool(groups) and b.path[:2] != groups[-1][0].path[:2]
        if not groups or size + n > target or (other and size >= max(1, target // 2)):
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += n + 2
    return groups


def structured_chunks(markdown: str, parent: int = 4000, child: int = 1000, overlap: int = 200, context: int = 1200) -> list[dict]:
    """Child chunks of parent groups; tables and code stay whole, each child carries its section and its parent's text around it."""
    out = []
    for number, group in enumerate(parent_groups(blocks(markdown), parent)):
        whole = "\n\n".join(b.text for b in group)
        pieces: list[tuple[str, Block]] = []
        plain: list[Block] = []

        def flush(plain: list[Block] = plain, pieces: list = pieces) -> None:
            if plain:
                units = [b.text for b in plain]
                pieces.extend((p, plain[0]) for p in pack(units, child, "\n\n", 0, lambda p: pack(sentence_units(p), child, "", overlap)))
                plain.clear()

        for b in group:
            if b.kind in ("table", "code"):
                flush()
                pieces.append((b.text, b))
            else:
                plain.append(b)
        flush()
        for i, (text, b) in enumerate(pieces):
            rest = whole.replace(text, "", 1).strip() if text in whole else whole
            if len(rest) > context:
                rest = rest[: context // 2].strip() + "\n...\n" + rest[-(context - context // 2 - 5) :].strip()
            head = "Section: " + " > ".join(b.path) if b.path else ""
            out.append({"content": text, "context": "\n\n".join(x for x in (head, rest) if x), "parent_index": number, "child_index": i, "kind": b.kind, "section": " > ".join(b.path)})
    return out


def graph_chunks(markdown: str, target: int = 3000, most: int = 4200, small: int = 1000, least_entities: int = 3) -> list[dict]:
    """C4: larger pieces for entity extraction; a piece with enough distinct capitalised tokens is a skeleton candidate."""
    out = []
    for group in parent_groups(blocks(markdown), target):
        for text in pack([u for b in group for u in sentence_units(b.text + "\n\n")], most, "", 0):
            names = len(set(re.findall(r"\b[A-Z][A-Za-z0-9-]{2,}", text)))
            rich = names >= least_entities
            for piece in (text,) if rich else pack(sentence_units(text), small):
                if piece.strip():
                    out.append({"content": piece.strip(), "graph_chunk_type": "skeleton_candidate" if rich else "peripheral", "graph_entity_count": names})
    return out


def episodes(text: str, most: int = 8000) -> list[str]:
    """Paragraphs packed into episodes, longer ones cut by sentences and at last by length."""
    cut = lambda s: [s[i : i + most] for i in range(0, len(s), most)]
    by_sentence = lambda p: pack(sentence_units(p), most, "", 0, cut)
    return [e for e in pack([p for p in text.split("\n\n") if p.strip()], most, "\n\n", 0, by_sentence) if e.strip()]


def greedy_budget(lengths: list[int], most: int = 10, chars: int = 18_000) -> list[bool]:
    """Keep items in order while they fit; one that does not fit is skipped, not the end."""
    kept, used, n = [], 0, 0
    for size in lengths:
        fits = n < most and used + size <= chars
        kept.append(fits)
        used += size * fits
        n += fits
    return kept


#: Characters of texts whose chunks are handed over at once.
MOST_CHARS = 1 << 20


def apply_chunker(docs: DataFrame, chunker: Callable[[str], list[dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, columns of ``schema``) for every chunk of every text; null texts have none."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for i, t in zip(frame["id"], frame["text"], strict=True):
                if t:
                    rows += [(i, *(c.get(n) for n in names)) for c in chunker(t)]
                    size += len(t)
                if size >= MOST_CHARS:  # what a task holds goes by the texts' length, not by the rows of a batch
                    yield pd.DataFrame(rows, columns=["doc_id", *names])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id long, {schema}")
