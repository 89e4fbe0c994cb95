"""The pipeline's near-duplicate stage against all pairs of true shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillgraph.llm import shingle_join
from quillgraph.llm.tables import plain_scan, with_places


def texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 300]))]
        for edits in (0, 0, 1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + ("\n" + line if rng.random() < 0.4 else ""))
    return [*out, "", None, "  \n", "A b", "a  B"]


def plain_kept(rows):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


@pytest.mark.parametrize("small", [64, 2])  # cells by all pairs, and by stars first
def test_stage_links_by_true_similarity(spark, monkeypatch, small):
    monkeypatch.setattr(shingle_join, "SMALL", small)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == plain_kept(rows)


def test_large_groups_beside_a_common_passage(spark, monkeypatch):
    """Near copies that share a frequent passage with unrelated texts: all pairs against the stage, in small slices."""
    monkeypatch.setattr(shingle_join, "SMALL", 4)
    monkeypatch.setattr(shingle_join, "SLICE", 16)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(90):
        base = [f"w{k}" for k in range(60)] if i % 3 else [f"u{i}x{k}" for k in range(rng.choice([4, 10, 60]))]
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words + passage)))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in got.collect()} == plain_kept(rows)


def test_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(None, one), (None, one), (1, one), (1, one), (2, one), (2, two), (3, two), (None, three), (None, three), (7, None), (8, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, one), (2, two), (None, three), (7, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_string_ids_and_clashing_columns(spark):
    one = " ".join(f"a{i}" for i in range(40))
    rows = [("b", one, "x", "y", 1), ("a", one, "x", "z", 2), ("c", "other", "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, fp string, component string, __row long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[1], rows[2]]


def test_parity_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((5, 9, 3), (100, 40, 30), (1000, 900, 850), (700, 20, 0), (0, 4, 0)):
        shared = rng.integers(0, 2**63, both, dtype=np.uint64)
        x = np.unique(np.concatenate([shared, rng.integers(0, 2**63, n - both, dtype=np.uint64)])) if n else np.zeros(0, np.uint64)
        y = np.unique(np.concatenate([shared, rng.integers(0, 2**63, m - both, dtype=np.uint64)]))
        got = shingle_join.apart(shingle_join.parity_sketch(x), shingle_join.parity_sketch(y))
        assert got <= len(np.setxor1d(x, y))


def test_row_places_are_the_same_at_every_reading(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert plain_scan(docs.where("doc_id > 3")) and not plain_scan(docs.crossJoin(spark.range(2)))
    rows = with_places(docs.where("doc_id > 3"), "t")
    once = {(r["__file"], r["__at"]): r.doc_id for r in rows.collect()}
    again = with_places(docs.select("*").where("doc_id > 3").where("doc_id > 100"), "t").collect()
    assert again and all(once[r["__file"], r["__at"]] == r.doc_id for r in again)
    assert len(once) == rows.count()
