"""Chunkers over all documents of the smallest table against plain re-computations of their rules, and cache keys."""

import hashlib
import re
import struct
from collections import defaultdict

import pytest

from quillgraph.plans import document_plans as D
from quillgraph.plans import question_plans as Q


def bare(text):
    return re.sub(r"\s+", "", text)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def by_doc(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def packed(units, most, glue):
    """Units joined while they fit; a unit that is too long alone stands alone."""
    out, held = [], ""
    for u in units:
        joined = held + glue + u if held else u
        if held and len(joined) > most:
            out.append(held)
            held = u
        else:
            held = joined
    return [*out, held] if held else out


def test_episodes_are_packed_paragraphs(spark, sf, texts):
    got = by_doc(D.c5_episodes(spark, sf).collect())
    short = 0
    for doc, text in texts.items():
        rows = sorted(got[doc], key=lambda r: r.episode)
        assert [r.episode for r in rows] == list(range(len(rows)))
        assert all(r.content.strip() and len(r.content) <= 8000 for r in rows)
        assert bare("".join(r.content for r in rows)) == bare(text)
        paragraphs = [p for p in text.split("\n\n") if p.strip()]
        if all(len(p) <= 8000 for p in paragraphs):
            short += 1
            assert [bare(r.content) for r in rows] == [bare(e) for e in packed(paragraphs, 8000, "\n\n")]
    assert short > 100


def test_graph_chunks_cover_the_text_and_count_names(spark, sf, texts):
    got = by_doc(D.c4_graph_chunks(spark, sf).collect())
    kinds = set()
    for doc, text in texts.items():
        rows = got[doc]
        kinds |= {r.graph_chunk_type for r in rows}
        without_headings = "\n".join(line for line in text.replace("\r", "\n").split("\n") if not re.match(r"#{1,6}\s", line))
        assert bare("".join(r.content for r in rows)) == bare(without_headings)
        for r in rows:
            assert (r.graph_chunk_type == "skeleton_candidate") == (r.graph_entity_count >= 3)
            own = len(set(re.findall(r"\b[A-Z][A-Za-z0-9-]{2,}", r.content)))
            # a peripheral piece may be part of the text whose names were counted
            assert own == r.graph_entity_count if r.graph_chunk_type == "skeleton_candidate" else own <= r.graph_entity_count
            longest = max(map(len, re.split(r"(?<=[.!?])\s+", r.content)), default=0)
            assert len(r.content) <= max(4200 if r.graph_chunk_type == "skeleton_candidate" else 1000, longest)
    assert kinds == {"skeleton_candidate", "peripheral"}


def test_structured_chunks_hold_all_blocks_with_context(spark, sf, texts):
    got = by_doc(D.c3_structured_chunks(spark, sf).collect())
    for doc, text in texts.items():
        rows = sorted(got[doc], key=lambda r: (r.parent_index, r.child_index))
        parents = sorted({r.parent_index for r in rows})
        assert parents == list(range(len(parents)))
        body = "\n".join(line for line in text.replace("\r", "\n").split("\n") if not re.match(r"#{1,6}\s", line))
        # pieces of a long block begin with the last 200 characters of the one before, which may cut a word
        assert set(re.findall(r"\w+", body)) <= set(re.findall(r"\w+", " ".join(r.content for r in rows)))
        assert all(bare(r.content[200:]) in bare(body) for r in rows)
        for p in parents:
            children = [r for r in rows if r.parent_index == p]
            assert [r.child_index for r in children] == list(range(len(children)))
            if len(children) == 1:
                assert children[0].context == (f"Section: {children[0].section}" if children[0].section else "")
            for r in children:
                assert len(r.context) <= 1200 + len("Section: \n\n") + len(r.section)
                assert not r.section or r.context.startswith(f"Section: {r.section}")


def test_cache_keys_are_digests_of_rounded_floats(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r.vec_id: r.cache_key for r in Q.f29_vector_cache_keys(spark, sf).collect()}
    assert got == {i: hashlib.md5(b"".join(struct.pack(">f", round(x, 4)) for x in v)).hexdigest() for i, v in vectors.items()}
    near = [[0.123449, 1.0], [0.12341, 1.0], [0.1236, 1.0], None]
    keys = {r.vec_id: r.cache_key for r in __import__("quillgraph.operators.questions", fromlist=["x"]).vector_cache_keys(spark.createDataFrame(list(enumerate(near)), "vec_id long, embedding array<double>"), "vec_id").collect()}
    assert keys[0] == keys[1] != keys[2] and keys[3] is None


def test_chunks_are_handed_over_by_length(spark, monkeypatch):
    """However many rows a batch has, no frame holds the chunks of more than one text beyond the limit."""
    import pandas as pd

    from quillgraph.operators import chunking as C

    docs, made = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, run, schema: made.append(run))
    C.apply_chunker(docs, lambda t: [{"content": c} for c in t], "content string")
    frames = list(made[0](iter([pd.DataFrame({"id": range(9), "text": ["xy" * (1 << 17)] * 4 + [None] + ["xy" * (1 << 18)] * 4})])))
    assert sum(map(len, frames)) == 4 * (1 << 18) + 4 * (1 << 19) and max(map(len, frames)) <= 1 << 20
    assert [sorted(set(f["doc_id"])) for f in frames if len(f)] == [[0, 1, 2, 3], [5, 6], [7, 8]]
