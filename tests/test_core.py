"""Operators outside the corpus subpackage: worked cases, plain re-computations, and the registry's contract."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking as C
from quillgraph.operators import entities as E
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import policy as P
from quillgraph.operators import retrieval as R
from quillgraph.operators import tfidf
from quillgraph.operators import vectors as V
from quillgraph.sources import readers as S
from quillgraph.streaming.limits import rate_limit


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_registry_is_consistent():
    import __spark_entry__ as entry
    from quillgraph.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 100


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


SAMPLE = ["k1_extract_terms", "k2_rank_keywords", "flt1_low_information", "f1_mention_score", "r3_bm25_search", "w6_fusion", "j14_knn_graph", "j8_trail_triples", "a19_grouped_accuracy", "f16_assertion_counts", "f21_evidence_contract", "w11_abort_after_empty", "snk8_trace_store", "st6_windowed_metrics"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, sf, name):
    from quillgraph.plans import registry

    df = registry.queries()[name](spark, sf)
    cur = duck(sf).execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda rows: Counter(tuple(str(plain(x)) for x in r) for r in rows)
    assert key(cur.fetchall()) == key(df.select(*names).collect())


def test_terms_of_mixed_scripts(spark):
    row = one(spark, t="Aspirin aspirin ß-x 高血压 哈哈 B12").select(X.terms(F.col("t")).alias("k")).first()
    assert row.k == ["aspirin", "b12", "高血", "血压", "高血压"]


def test_idf_of_worked_case(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, " "), (4, None)], "doc_id long, text string")
    got = {r.term: r.idf for r in tfidf.idf_table(docs).collect()}
    assert got["alpha"] == pytest.approx(math.log(3 / 3) + 1) and got["beta"] == pytest.approx(math.log(3 / 2) + 1)


def test_information_scores(spark):
    rows = spark.createDataFrame([("",), (None,), ("   ",), ("!!!!",), ("the the the the the the the the the",), ("Metformin lowers fasting glucose in adults 5 mg",)], "t string")
    assert [r[0] for r in rows.select(X.information_score(F.col("t"))).collect()] == [0.0, 0.0, 0.0, 1.0, 3.0, 5.0]


def test_quantitative_facts(spark):
    row = one(spark, t="eGFR ≥ 30.0, 每日两次 5 mg 3次/周").select(X.quantitative_facts(F.col("t")).alias("f")).first()
    assert row.f == ["comparison:30:>=", "frequency:2:day", "frequency:3:week", "quantity:5:mg"]


def test_assertion_precedence(spark):
    rows = spark.createDataFrame([("不能排除肺炎", "肺炎"), ("否认糖尿病", "糖尿病"), ("父亲患糖尿病", "糖尿病"), ("无发热，但有咳嗽", "咳嗽"), ("eGFR<30时禁用二甲双胍", "二甲双胍"), ("x", "y")], "s string, e string")
    got = [r[0] for r in rows.select(P.classify_assertion(F.col("s"), F.col("e"))["label"]).collect()]
    assert got == ["speculated", "negated", "family_history", "affirmed", "conditional", "affirmed"]


def test_vectors_by_blocks(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(90, [0.0] * 6), (91, [1.0] * 6), (92, [1.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "BLOCK", 20)
    got = defaultdict(list)
    for r in V.block_top_k(df.withColumnRenamed("vec_id", "query_id"), df, 5, exclude_self=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    vec = dict(data)
    for i in vec:
        assert got[i] == sorted((j for j in vec if j != i), key=lambda j: (-cos(vec[i], vec[j]), j))[:5]


def test_blocks_meet_in_every_partition(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, V.block_top_k(q, df, 5).select("query_id", "rank", "vec_id").collect()))
    monkeypatch.setattr(V, "BLOCK", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, V.block_top_k(q, df, 5).select("query_id", "rank", "vec_id").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) == 150 and got == want and all(v == q for q, rank, v in got if rank == 1)


#: Queries whose neighbours come from several blocks of vectors.
BLOCKED = ["a40_top_evidence_signal", "a7_adaptive_cut", "r1_vector_top_k", "r2_vector_provider", "r5_graph_provider", "r7_passage_vector_search", "r8_temporal_boost", "r9_full_document_read", "s1_ordered_union"]


@pytest.mark.parametrize("name", BLOCKED)
def test_queries_of_many_blocks_equal_their_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_queries_equal_their_sql(spark, sf, name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


#: Queries whose full-text search goes over several groups of ranges.
GROUPED = ["a40_top_evidence_signal", "x1_question_loop", "r11_comprehensive_fold", "r10_hybrid_search", "a16_provider_diagnostics"]


@pytest.mark.parametrize("name", GROUPED)
def test_queries_of_many_groups_equal_their_sql(spark, sf, name, monkeypatch):
    from quillgraph.operators import inverted_index as II

    monkeypatch.setattr(II, "GROUP", 20)
    test_queries_of_many_blocks_equal_their_sql(spark, sf, name, monkeypatch)


#: Queries that show a vector's score, and whether their question's own document is there.
SCORED = [("a40_top_evidence_signal", False), ("w6_fusion", True), ("j14_knn_graph", True), ("r1_vector_top_k", True), ("r2_vector_provider", True), ("prj6_vector_finalise", True), ("r7_passage_vector_search", True), ("r8_temporal_boost", True)]


@pytest.mark.parametrize("name, own", SCORED)
def test_scores_round_as_their_sql_does(spark, tmp_path, name, own):
    import duckdb
    from quillgraph.plans import registry

    score = 0.5047875  # a half by its digits, times a million just below one
    con = duckdb.connect()
    con.execute(f"create table embeddings as select * from (values (0::bigint, [1.0::double, 0.0], 0), (1, [{score!r}::double, {math.sqrt(1 - score * score)!r}], 1)) t(vec_id, embedding, label)")
    con.execute(f"create table documents as select * from (values (0::bigint, 'alpha beta', 'a'), (1, 'gamma delta', 'a')) t(doc_id, text, source) where doc_id >= {0 if own else 1}")
    for t in ("embeddings", "documents"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    cur = con.execute(registry.oracle_sql()[name])
    want = Counter(tuple(map(str, r)) for r in cur.fetchall())
    assert any("0.504787" in r for r in want)
    assert want == Counter(tuple(map(str, r)) for r in registry.queries()[name](spark, str(tmp_path)).select(*(d[0] for d in cur.description)).collect())


def test_reachable_reads_its_edges_once(spark, tmp_path):
    path = f"file://{tmp_path}/edges"
    spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5)], "src long, dst long").write.parquet(path)
    found = G.reachable(spark.createDataFrame([(1,), (1,), (9,)], "id long"), spark.read.parquet(path), 3)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3)]
    assert not any(str(tmp_path) in f for f in found.inputFiles())


def test_adaptive_cut(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.4), (2, 0.3), (3, -0.1)], "query_id long, score double")
    got = {r.query_id: r.cut for r in V.adaptive_cut(rows).collect()}
    mean = 0.6
    sd = math.sqrt(sum((x - mean) ** 2 for x in (0.9, 0.5, 0.4)) / 3)
    assert got[1] == pytest.approx(min(max(0.5, mean + sd), 0.9)) and got[2] == 0.3 and got[3] == 1.0


def test_fusion_prefers_channels_in_order(spark):
    rows = [(1, "a", 0.2, 0.2, 1, "vector"), (1, "b", 9.0, 0.9, 1, "bm25"), (1, "a", 7.0, 0.7, 2, "bm25"), (1, "c", 1.0, None, 1, "graph"), (1, "d", 1.0, 0.1, 1, "other")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, score_normalized double, rank int, source string")
    got = R.fuse(df, 4).orderBy("rank").collect()
    assert [(r.chunk_id, r.source, r.score_normalized) for r in got] == [("a", "vector", 0.7), ("b", "bm25", 0.9), ("c", "graph", None), ("d", "other", 0.1)]


def test_pagerank_sums_to_one_and_matches_plain(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (1, 0, 1.0), (3, 2, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    got = {r.id: r.score for r in G.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long, weight double"), iterations=5).collect()}
    score = dict.fromkeys(range(5), 0.2)
    out = defaultdict(float)
    for a, _, w in edges:
        out[a] += w
    for _ in range(5):
        loose = sum(s for n, s in score.items() if not out.get(n))
        score = {n: 0.85 * (sum(score[a] * w / out[a] for a, b, w in edges if b == n) + loose / 5) + 0.03 for n in score}
    assert got == pytest.approx(score) and sum(got.values()) == pytest.approx(1)


def test_signatures_without_listing_tokens(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("eEdD-_ .ßéK中\t\n9") for _ in range(rng.randrange(14))),) for _ in range(600)]
    t = F.col("t")
    df = spark.createDataFrame([*rows, ("--ed",), ("a-ed",), ("e-_d",), ("中ed",), ("",)], "t string")
    long_way = F.regexp_replace(F.regexp_replace(X.fold(F.trim(t)), "[\\s\\-_/.]+", ""), f"[^0-9a-z{X.CJK}]+", "")
    got = df.select(X.has_token_signature(t, F.lit("ed")).alias("found"), F.array_contains(X.token_signatures(t), "ed").alias("held"), X.alias_signature(t).alias("sig"), long_way.alias("want")).collect()
    assert all(r.found == r.held and r.sig == r.want for r in got) and 0 < sum(r.found for r in got) < len(got)
    passages = df.select(F.monotonically_increasing_id().alias("passage_id"), t.alias("text"))
    names = spark.createDataFrame([("eed",), ("en de",), ("dd ee 9",)], "name string")
    found = G.mention_scan(passages, names)
    assert "A-Za-z0-9][A-Za-z0-9_-]*" not in found._jdf.queryExecution().optimizedPlan().toString()  # no token is listed
    every = F.explode(X.mention_scores(F.col("text"), F.array(*map(F.lit, ("eed", "en de", "dd ee 9"))))).alias("s")
    want = passages.select("passage_id", every).where("s.score > 0").select(F.col("s.form").alias("name"), "passage_id", F.col("s.score").alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_signal_joins_only_rare_terms(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("alpha", "be", "gammas", "delta") for b in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[: rng.choice((6, 160))]) for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    every = {(r.doc_id, r.rank): r.term for r in tfidf.top_keywords(tfidf.scored_terms(docs)).collect()}
    for held in (0, 12, 1000):
        monkeypatch.setattr(tfidf, "FREQUENT", held)
        rows = tfidf.strongest_terms(docs)
        assert {(r.doc_id, r.rank): r.term for r in tfidf.top_keywords(rows).collect()} == every
    assert rows.count() <= 8 * 120 < tfidf.scored_terms(docs).count()
    assert tfidf.signal_scores(docs).count() == 122


def test_trails_use_an_edge_once(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, 1, "z")], "src long, dst long, relation_type string")
    got = Counter((r.node, r.length) for r in G.trails(spark.createDataFrame([(1,)], "id long"), edges, 3).collect())
    assert got == {(2, 1): 1, (3, 1): 1, (3, 2): 1, (2, 2): 1, (1, 3): 2}
    near = {r.node: r.hops for r in G.reachable(spark.createDataFrame([(1,)], "id long"), edges, 3).collect()}
    assert near == {2: 1, 3: 1}


def test_skeleton_sizes(spark):
    got = [r[0] for r in spark.range(1, 25).select(G.skeleton_size(F.col("id")).cast("int")).collect()]
    assert got == [min(max(1, int(n * 0.25)), max(2, (n + 1) // 2)) if n <= 10 else max(1, int(n * 0.25)) for n in range(1, 25)]


def test_claims(spark):
    claims = spark.createDataFrame([(1, ["aspirin"], ["5 mg"], []), (2, ["aspirin"], ["7 mg"], []), (3, ["zzz"], [], [])], "claim_id int, entities array<string>, numbers array<string>, actions array<string>")
    ev = spark.createDataFrame([(i, p, f"e{p}", t) for i in (1, 2, 3) for p, t in ((1, "nothing"), (2, "Aspirin 5 mg"))], "claim_id int, pos int, chunk_id string, content string")
    got = {r.claim_id: (r.level, r.failure, r.chunk_id) for r in P.check_claims(claims, ev).collect()}
    assert got == {1: ("correct", "none", "e2"), 2: ("incorrect", "hard_fail", "e2"), 3: ("possible_correct", "hard_fail", "")}


def test_packing_keeps_text_and_limits():
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(0, 80)))
        pieces = list(C.pack(C.sentence_units(text), 60))
        assert "".join(pieces) == text
        assert all(len(p) <= 60 or len(C.sentence_units(p)) == 1 for p in pieces)
    assert list(C.pack(["aaaa", "bbbb", "cccc"], 9, "-", 2)) == ["aaaa-bbbb", "bb-cccc"]


def test_chunks_of_sections():
    text = "lead\n## Facts\n\n| a | b |\n| 1 | 2 |\n### Long\n" + "One sentence here. " * 30 + "\n\nshort tail"
    got = C.chunk_text(text, 100, 20)
    assert got[0]["content"] == "lead" and got[1] == {"content": "\n| a | b |\n| 1 | 2 |", "section": "Facts", "chunk_index": 1, "chunk_id": got[1]["chunk_id"]}
    assert {c["section"] for c in got[2:]} == {"Long"} and got[-1]["content"].endswith("short tail")
    assert C.chunk_text("  \n") == []


def test_blocks_follow_headings():
    md = "# T\npara\nmore\n\n## L\n- a\n- b\n\n1. x\n2. y\n3. z\n4. w\n```\n# code\n```\n| t |\nend"
    got = [(b.kind, b.text, b.path) for b in C.blocks(md)]
    assert got == [("paragraph", "para\nmore", ["T"]), ("list", "- a\n- b", ["T", "L"]), *[("list_item", f"{i}. {c}", ["T", "L"]) for i, c in enumerate("xyzw", 1)], ("code", "```\n# code\n```", ["T", "L"]), ("table", "| t |", ["T", "L"]), ("paragraph", "end", ["T", "L"])]
    assert C.greedy_budget([5, 9, 4], chars=10) == [True, False, True]


def test_entity_merge_is_greedy(spark):
    rows = [{"entity_type": "D", "name": n, "aliases": a, "chunks": [n], "confidence": c, "description": d} for n, a, c, d in (("Blood Pressure", ["BP"], 0.2, ""), ("bp", [], 0.9, "x"), ("other", [], 0.1, ""))]
    got = E.merge_entities(rows)
    assert [(m["name"], m["aliases"], m["confidence"], m["description"]) for m in got] == [("Blood Pressure", ["BP", "bp"], 0.9, "x"), ("other", [], 0.1, "")]
    assert E.rouge_l("the cat sat", "the cat ran sat") == pytest.approx(6 / 7) and E.rouge_l("", "a") == 0
    names = spark.createDataFrame([("metformin",), ("zzz",)], "name string")
    known = spark.createDataFrame([("metformine",), ("metfor",)], "name string")
    assert [(r.name, r.known) for r in E.fuzzy_match(names, known).collect()] == [("metformin", "metformine")]


def test_rejected_requests_do_not_count(spark):
    rows = spark.createDataFrame([(1, float(t), n) for n, t in enumerate((0, 1, 2, 3, 59, 60, 61, 62, 200))], "k long, s double, n long").withColumn("at", F.timestamp_seconds("s"))
    got = [r.allowed for r in rate_limit(rows, "k", "at", "n", most=3, seconds=60).orderBy("n").collect()]
    hits, want = [], []
    for t in (0, 1, 2, 3, 59, 60, 61, 62, 200):
        hits = [h for h in hits if h > t - 60]
        want.append(len(hits) < 3)
        hits += [t] * want[-1]
    assert got == want


def test_streamed_windows_equal_the_batch(spark, sf, tmp_path):
    import shutil

    from quillgraph.streaming.metrics import hourly, read_events

    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "a.parquet")
    stream = hourly(read_events(spark, f"file://{folder}"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_test").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = hourly(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(str, spark.table("hourly_test").collect())) == sorted(map(str, batch.collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff")
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "b.bin").write_text("no")
    assert [(r.name, r.text) for r in S.read_documents(spark, f"file://{tmp_path}").collect()] == [("a.md", "ok �")]
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "query": "why", "evidence_chunks": ["a", "b"], "query_type": "simple"}]}')
    assert [(r.id, r.question, r.evidence, r.question_type) for r in S.read_questions(spark, f"file://{tmp_path}/q.json").collect()] == [("1", "why", "a; b", "simple")]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in S.read_jsonl(spark, f"file://{tmp_path}/r.jsonl", limit=1).collect()] == [1]


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "id int, v string, seq int")
    assert sorted((r.id, r.v) for r in S.upsert(old, new, ["id"], ["seq"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_label_report(spark):
    cells = M.confusion(spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "g string, p string"), "g", "p")
    got = {r.label: (r.precision, r.recall, r.support) for r in M.per_label(cells).collect()}
    assert got == {"x": (1.0, 0.5, 2), "y": (0.5, 1.0, 1)}


def test_package_reaches_workers_from_another_folder(tmp_path):
    """A driver outside the repository, without PYTHONPATH: workers get the package as a file."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from quillgraph.session import local_session, ship_package
spark = local_session(2, "1g", 2, "elsewhere")
ship_package(spark)
def run(frames):
    import quillgraph.functions.lexicons
    for frame in frames:
        yield frame
print("rows", spark.range(5).mapInPandas(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 5" in done.stdout, done.stderr[-2000:]


def test_only_the_missing_subpackage_is_passed_over(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def missing(name):
        def load(_):
            raise ModuleNotFoundError(name=name)

        return load

    monkeypatch.setattr(importlib, "import_module", missing("quillgraph.llm.queries"))
    assert entry._corpus() is None
    monkeypatch.setattr(importlib, "import_module", missing("zstandard"))
    with pytest.raises(ModuleNotFoundError):
        entry._corpus()
