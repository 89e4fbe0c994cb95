"""The stored index against an exhaustive plain BM25 and a plain phrase matcher."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import inverted_index as II
from quillgraph.operators import retrieval as R

TOKEN = II.TOKEN


def corpus():
    rng = random.Random(3)
    common, rare = ["the", "of", "and", "cell", "Graph"], [f"term{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        words = rng.choices(common, k=rng.randrange(5, 40)) + rng.sample(rare, 3) * rng.choice([1, 1, 4])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (2003, "高血压患者每日服药，高血压"), (2004, "the " * 40_000 + "term7"), (5, "term5 term6 again"), (None, "term5 without an id")]
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in corpus()], "doc_id long, text string, term string, ids string").repartition(3)
    return II.build(docs, str(tmp_path_factory.mktemp("index") / "one"))


def plain_scores(rows, queries):
    tokens = [[m.lower() for m in TOKEN.findall(t or "")] for _, t in rows]
    avg = sum(map(len, tokens)) / len(rows)
    df = Counter(w for t in tokens for w in set(t))
    norm = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for q, terms in queries.items():
        scored = defaultdict(float)
        for (i, _), t in zip(rows, tokens, strict=True):
            tf = Counter(t)
            for w in terms:
                if tf[w]:
                    scored[i] += idf[w] * norm(tf[w], len(t))
        out[q] = scored
    return out, tokens, idf, norm


def test_pruned_top_k_equals_exhaustive_scores(spark, index):
    rng = random.Random(9)
    queries = {q: sorted(set(rng.choices(["the", "graph", "cell"], k=q % 3) + [f"term{rng.randrange(300)}" for _ in range(1 + q % 4)])) for q in range(60)}
    queries[60], queries[61] = ["nowhere"], ["the", "nowhere"]
    rows = [r for r in corpus() if r[0] not in (5, None)] + [(i, t) for i, t in corpus() if i is None or (i == 5 and t)]
    want, *_ = plain_scores(rows, queries)
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query_id long, term string")
    found = II.bm25(index, asked, 10)
    got = defaultdict(list)
    for r in found.results.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    for q in queries:
        # id 5 stands for two documents; its scores add up on both sides
        best = sorted(((round(s, 9), i) for i, s in want[q].items()), key=lambda x: (-x[0], -1 if x[1] is None else x[1]))[:10]
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for s, _ in best]
        assert {i for i, s in got[q] if s > best[-1][0]} == {i for s, i in best if s > best[-1][0]} if best else not got[q]
    totals = found.ranges.agg(F.sum("n_ranges"), F.sum("n_scored")).first()
    assert totals[1] < totals[0], "some ranges are skipped"


def test_index_figures_and_profile(index):
    rows = corpus()
    assert (index.n, index.filled) == (len(rows), sum(bool((t or "").strip()) for _, t in rows))
    df = Counter(w for _, t in rows for w in {m.lower() for m in TOKEN.findall(t or "")})
    got = {r.term: r.df for r in II.profile(index).collect()}
    assert {w: n for w, n in got.items() if re.fullmatch("[a-z0-9]+", w)} == {w: n for w, n in df.items() if re.fullmatch("[a-z0-9]+", w)}
    assert got["高血压"] == 1 and got["血压患"] == 1 and "高" not in got
    assert index.terms.agg(F.max("n_docs")).first()[0] <= II.RANGE


def test_clauses_equal_a_plain_matcher(spark, index):
    rng = random.Random(4)
    rows = corpus()
    texts = [[m.lower() for m in TOKEN.findall(t or "")] for i, t in rows if i is not None]
    clauses = []
    for q in range(40):
        some = rng.choice([t for t in texts if len(t) > 6])
        at = rng.randrange(len(some) - 4)
        clauses += [(q, "a", True, some[at : at + 1 + q % 4]), (q, "b", False, some[:2]), (q, "c", q % 5 == 0, ["the"])]
    clauses += [(100, "a", True, ["高", "血", "压"]), (101, "a", True, ["nowhere"]), (101, "b", False, ["the"]), (102, "a", True, ["the", "the", "the"])]
    _, tokens, idf, norm = plain_scores(rows, {})
    want = defaultdict(dict)
    for q in {c[0] for c in clauses}:
        for (i, _), t in zip(rows, tokens, strict=True):
            score, met = 0.0, 0
            ok = True
            for _, _, must, words in (c for c in clauses if c[0] == q):
                tf = sum(t[p : p + len(words)] == words for p in range(len(t) - len(words) + 1))
                if tf:
                    score, met = score + sum(idf[w] for w in words) * norm(tf, len(t)), met + 1
                ok &= bool(tf) or not must
            if ok and met and i != 5:
                want[q][i] = (round(score, 6), met)
    table = spark.createDataFrame(clauses, "query_id long, clause string, must boolean, tokens array<string>")
    got = defaultdict(dict)
    for r in II.clause_search(index, table, k=10_000).collect():
        if r.chunk_id != 5:
            got[r.query_id][r.chunk_id] = (round(r.score, 6), r.n_clauses)
    for q in want:
        assert set(got[q]) == set(want[q]) and all(got[q][i] == pytest.approx(want[q][i], abs=2e-6) for i in want[q]), q
    assert set(got) == set(want) and got[100] and 101 not in got


def test_an_index_without_documents(spark, tmp_path):
    index = II.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "the")], "query_id long, term string")
    assert (index.n, index.avg_len) == (0, 0.0) and II.bm25(index, asked).results.count() == 0


def test_the_shared_index_is_built_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert II.shared(docs) is II.shared(spark.read.parquet(f"{sf}/documents.parquet"))


def test_benchmark_questions_are_pruned_without_loss(spark, sf):
    from quillgraph.plans import retrieval_plans as P
    from quillgraph.plans.kit import text_index

    index, asked = text_index(spark, sf), P._bench_terms(spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    queries = defaultdict(list)
    for r in asked.collect():
        queries[r.query_id].append(r.term)
    want, *_ = plain_scores(rows, queries)
    got = defaultdict(list)
    for r in II.bm25(index, asked).results.orderBy("rank").collect():
        got[r.query_id].append(round(r.score, 6))
    assert {q: v for q, v in got.items()} == {q: [round(x, 6) for x in sorted((round(s, 9) for s in w.values()), reverse=True)[:10]] for q, w in want.items()}


def test_anchors_of_questions(spark):
    rows = [("Who treated Captain James Cook in New South Wales with aspirin, aspirin or vitamin_c daily",), ("The Big One",), ("",), ("高血压 患者 of Rare Disease",), ("a an",)]
    got = [tuple(map(tuple, r)) for r in spark.createDataFrame(rows, "t string").select(R.anchors(F.col("t")).alias("a")).select("a.required", "a.optional").collect()]
    assert got[0] == (("treated", "aspirin", "vitamin_c"), ("Captain James Cook", "New South Wales"))
    assert got[1] == (("Big One",), ()) and got[2] == ((), ()) and got[4] == ((), ())
    assert got[3] == (("高血压",), ("Rare Disease",))


def test_blocks_equal_a_plain_listing(spark, monkeypatch):
    import collections

    from quillgraph.operators import inverted_index as II

    monkeypatch.setattr(II, "RANGE", 4)
    texts = ["Alpha beta alpha", None, "", "  ", "beta x 高血压 高血压 A-b", "İstanbul K2 ßeta", "alpha " * 5, "哈哈 alpha_1", "end beta"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.term, r.range): (list(r.ids), list(r.tfs), list(r.lens), [list(p) for p in r.positions]) for r in II._blocks(df, "doc_id", "text").collect()}
    want = {}
    for number in range(3):
        part = rows[number * 4 : number * 4 + 4]
        found = collections.defaultdict(list)
        tokens = {i: [t.lower() for t in II.TOKEN.findall(t or "")] for i, t in part}
        for i, t in part:
            found[II.EVERY].append((i, int(bool((t or "").strip())), len(tokens[i]), []))
            for term in dict.fromkeys(tokens[i]):
                at = [n for n, x in enumerate(tokens[i]) if x == term]
                found[term].append((i, len(at), len(tokens[i]), at))
            for term, tf in II.cjk_grams(t or "").items():
                found[term].append((i, tf, len(tokens[i]), []))
        want |= {(term, number): tuple(map(list, zip(*held))) for term, held in found.items()}
    assert got == want


def test_blocks_stay_where_their_range_was_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"same words here w{i % 7} w{i % 11}") for i in range(700)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = II.build(docs, f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = index.blocks.select("range", "term", F.input_file_name().alias("file")).collect()
    files = {}
    for r in rows:
        files.setdefault(r.range, set()).add(r.file)
    assert len(files) >= 6 and all(len(f) == 1 for f in files.values())  # nothing was dealt anew by term
    assert index.n == 700 and all([r.term for r in rows if r.file == f] == sorted(r.term for r in rows if r.file == f) for f in {r.file for r in rows})


def test_a_search_stores_no_pair_of_query_and_range(spark, index, monkeypatch):
    stored = []
    monkeypatch.setattr(II, "materialize", lambda df, tag, old=II.materialize: (stored.append(old(df, tag)), stored[-1])[1])
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in ("the", f"term{q}")], "query_id long, term string")
    assert II.bm25(index, asked).results.count() == 400
    assert stored and max(f.count() for f in stored) <= 80


def test_an_index_is_written_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    written = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, old=DataFrameWriter.parquet, **b: (written.append(path), old(self, path, *a, **b))[1])
    II.build(spark.createDataFrame([(1, "a few words")], "doc_id long, text string"), f"file://{tmp_path}/index")
    assert sorted(p.rsplit("/", 1)[1] for p in written) == ["blocks", "figures"]
