"""Operators on names, vectors, evidence and phrases against plain re-computations."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import plugins
from quillgraph.operators import control as C
from quillgraph.operators import entities as E
from quillgraph.operators import evidence as V
from quillgraph.operators import filters
from quillgraph.operators import graph as G
from quillgraph.operators import phrases as P
from quillgraph.operators import questions as Q
from quillgraph.operators import vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(60)]

    def near(w):
        w = list(w)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice("abcde")]])
        return "".join(w) or "a"

    names, known = sorted({near(w) for w in base for _ in range(3)}), sorted(set(base))
    want = {}
    for n in names:
        best = max(((SequenceMatcher(None, n, k).ratio(), k) for k in known), default=None)
        if best[0] >= 0.88:
            want[n] = (best[1], pytest.approx(best[0]))
    got = E.fuzzy_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert {r.name: (r.known, r.ratio) for r in got.collect()} == want and len(want) > 30


def test_entity_groups_merge_like_the_whole_type(spark):
    rng = random.Random(4)
    words = ["Blood", "Pressure", "High", "Low", "Heart", "Rate"]
    rows = []
    for i in range(80):
        name = " ".join(rng.sample(words, rng.randint(1, 3)))
        rows.append({"entity_type": rng.choice(["D", "T"]), "seq": i, "name": f"{name} {i % 37}", "aliases": [" ".join(rng.sample(words, 2))] if rng.random() < 0.3 else [], "chunks": [str(i)], "confidence": i / 80, "description": "" if i % 2 else str(i)})
    want = sorted((m["entity_type"], m["name"], tuple(m["aliases"]), tuple(m["chunks"])) for t in "DT" for m in E.merge_entities([r for r in rows if r["entity_type"] == t]))
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "entity_type string, seq long, name string, aliases array<string>, chunks array<string>, confidence double, description string")
    got = sorted((r.entity_type, r.name, tuple(r.aliases), tuple(r.chunks)) for r in E.merge_by_type(table).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [set(g[3]) for g in got] == [set(w[3]) for w in want]


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert E.common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


def test_index_recall_and_exact_mode(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    cells, probes = vectors.fit_index(e, sample=1500)
    assert probes < len(cells) / 2
    exact = {(r.query_id, r.vec_id) for r in vectors.block_top_k(q, e, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.indexed_top_k(q, e, 10, cells, probes).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    everything = vectors.indexed_top_k(q, e, 10, cells, probes=len(cells))
    assert {(r.query_id, r.vec_id) for r in everything.collect()} == exact


def test_index_recall_on_the_fixture(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in vectors.block_top_k(q, e, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.indexed_top_k(q, e, 10, *vectors.fit_index(e)).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_trail_triples_against_a_plain_search(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(16)} - {(i, i) for i in range(9)})
    want = set()

    def walk(node, used):
        for k, (a, b) in enumerate(edges):
            if k not in used and node in (a, b) and len(used) < 3:
                end = b if node == a else a
                path = (*used, k)
                want.update((end, *edges[e], len(path)) for e in path)
                walk(end, path)

    for seed in (0, 4):
        walk(seed, ())
    table = spark.createDataFrame([(a, b, "r") for a, b in edges], "src long, dst long, relation_type string")
    got = G.trail_triples(spark.createDataFrame([(0,), (4,)], "id long"), table, 3).collect()
    assert {(r.connected, r.src, r.dst, r.length) for r in got} == want and len(got) == len(want)


def test_trail_ends_are_shuffled_as_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "LISTED", 2)
    edges = [(a, b, f"{a}-{b}") for a, b in ((0, 1), (1, 0), (1, 2), (1, 3), (4, 1), (1, 5), (2, 3), (3, 5), (5, 1), (6, 5))]
    table = spark.createDataFrame(edges, "src long, dst long, relation_type string")
    seeds = spark.createDataFrame([(0,), (3,)], "id long")
    got = G.trail_triples(seeds, table, 3)
    want = {(t.node, e.src, e.dst, t.length) for t in G.trails(seeds, table, 3).collect() for e in t.path}
    rows = [(r.connected, r.src, r.dst, r.length) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(")]  # what becomes of the single ends
    assert "Exchange" not in above


def test_only_transient_failures_are_retried():
    slept = []
    call = plugins.RetryingCall(max_retries=2, jitter=0, longest_wait=3, max_failures_in_row=10, sleep=slept.append, clock=lambda: 0.0)

    def fails(error):
        def f():
            raise error

        return f

    with pytest.raises(KeyError):
        call(fails(KeyError("x")))
    assert slept == [] and call.failures == 0
    with pytest.raises(RuntimeError, match="503"):
        call(fails(RuntimeError("503 upstream, retry_after: 99")))
    assert slept == [3, 3] and call.failures == 3
    with pytest.raises(plugins.CallFailed, match="circuit"):
        plugins.RetryingCall(max_failures_in_row=1, sleep=slept.append)(fails(RuntimeError("timeout")))


def test_short_repeats_and_low_information(spark):
    texts = ["ok", " ok ", "ok then", None, "", "the............", "5 mg", "5 mg", "a longer text that says one thing or another", "word " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    short = {r.id for r in filters.short_repeats(rows).where("short_repeat").collect()}
    assert short == {0, 1, 6, 7}
    kept = {r.id for r in filters.low_information(rows).where("kept").collect()}
    assert kept == {2, 6, 7, 8, 9}
    nothing = filters.low_information(rows.where("id in (3, 4)"))
    assert nothing.where("kept").count() == 2


def test_query_terms_and_anchors(spark):
    r = one(
        spark,
        P.query_terms(F.lit("什么是二甲双胍的剂量？ eGFR 30.5 medical x aliases")).alias("terms"),
        P.query_anchors(F.lit("What is the eGFR for DAPT and 二甲双胍?")).alias("anchors"),
        P.query_terms(F.lit("PCI术后患者需要怎么办")).alias("cut"),
    )
    assert r.terms == ["二甲双胍的剂量", "egfr", "30.5"] or "egfr" in r.terms and "medical" not in r.terms
    assert r.anchors == ["is", "egfr", "dapt", "二甲双胍"] and "患者" not in r.cut


def test_source_text_and_quality(spark):
    r = one(
        spark,
        V.source_text(F.lit("Section: a\nFocus: b\n\nBody one\nBody two")).alias("body"),
        V.source_text(F.lit("Section: a\n line \n\t\n")).alias("line"),
        V.source_text(F.lit("Section: a")).alias("only"),
        V.source_text(F.lit(None).cast("string")).alias("none"),
        V.source_quality(F.lit("prose\n- item\na -- r --> b")).alias("mixed"),
        V.source_quality(F.lit("x aliases: y")).alias("made"),
    )
    assert (r.body, r.line, r.only, r.none) == ("Body one\nBody two", "line", "Section: a", "")
    assert r.mixed == pytest.approx(1.0 - 1 / 3) and r.made == 0


def test_windows_and_packing(spark):
    lines = F.array(*map(F.lit, ("Head：", "- no", "- drug 禁用", "- 至少 3", "other", "- drug")))
    r = one(spark, V.sentence_window(lines, F.lit(2), F.array(F.lit("drug"))).alias("w"), V.pack_sizes(F.array(*map(F.lit, (50, 20, 40, 70, 1))), 60).alias("g"))
    assert r.w == "Head： - drug 禁用 - 至少 3" and r.g == [0, 1, 1, 2, 3]


def test_compressed_graph_results(spark):
    text = "Graph paths:\n" + "\n".join("abcdefgh") + "\n\nEntities:\nx\n\nEvidence:\n" + "e" * 500
    r = one(spark, V.compress_graph_result(F.lit(text), 100).alias("t"), V.compress_graph_result(F.lit(" short "), 100).alias("s"))
    assert r.t == "Graph paths:\na\nb\nc\nd\n\nEntities:\nx\n\nEvidence:\n" + "e" * 50 and r.s == "short"


def test_structural_phrases(spark):
    text = "Metformin (二甲双胍, also) is\n剂量：\n- eGFR: low\n(x) plain"
    got = [tuple(x) for x in one(spark, P.structural_phrases(F.lit(text)).alias("p")).p]
    assert ("Metformin", "二甲双胍", "parenthetical_alias") in got and ("二甲双胍", "", "parenthetical_alias") in got
    assert ("剂量", "", "heading") in got and ("eGFR", "", "list_head") in got


def test_needs_names_and_confidence(spark):
    r = one(
        spark,
        P.resolved_needs(F.lit('{"retrieval_needs": ["broad_recall", "nonsense", "semantic_passage"], "reason": " r "}')).alias("good"),
        P.resolved_needs(F.lit("[]")).alias("bad"),
        *(P.confidence(F.lit(v)).alias(k) for k, v in (("low", "-1"), ("high", "7"), ("text", "x"), ("nan", "NaN"))),
    )
    assert (r.good.needs, r.good.reason) == (["semantic_passage", "broad_recall"], "r") and r.bad.needs == ["semantic_passage"]
    assert (r.low, r.high, r.text, r.nan) == (0.0, 1.0, None, None)
    names = spark.createDataFrame([("a", "HTN"), ("a", "hypertension"), ("a", "高血压"), ("b", "Bp"), ("b", "BP")], "k string, name string")
    got = {r.k: (r.name, r.aliases) for r in P.preferred_names(names, "k").collect()}
    assert got == {"a": ("高血压", ["HTN", "hypertension"]), "b": ("Bp", ["BP"])}


def test_vectors_must_match_chunks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert P.zip_vectors(a, b, "id").count() == 2
    for wrong in (b.limit(1), b.unionByName(b)):
        with pytest.raises(ValueError):
            P.zip_vectors(a, wrong, "id")


def test_json_salvage(spark):
    rows = spark.createDataFrame([(1, 'x {"a": 1} {"a": 2}'), (2, "none"), (3, None), (4, '{"a": {"b": "}"}}')], "id long, raw string")
    got = {r.id: r["value"] for r in Q.salvage(rows, "raw", "a string").collect()}
    assert got[1].a == "1" and got[2] is None and got[3] is None and "}" in got[4].a
    assert Q.segments(spark.createDataFrame([(1, '{"a": 1} junk [2] {')], "id long, raw string"), "raw").count() == 2


def test_prompt_selection_covers_anchors_first():
    pick = C.prompt_selection
    assert pick([5, 5, 5], [set(), {"b"}, {"a"}], [False] * 3, [0.9, 0.1, 0.2], ["a", "b"], 2) == [2, 1]
    assert pick([50, 5], [set(), set()], [False, True], [0.9, 0.1], [], 5, 10) == [1]
    assert pick([50], [set()], [False], [0.9], [], 5, 10) == [0]
    assert pick([4, 4, 4], [set()] * 3, [False] * 3, [0.1, 0.3, 0.2], [], 2) == [1, 2]


def test_prompt_selection_over_a_table(spark):
    results = spark.createDataFrame([(1, 10, 1, 0.9, "x" * 30), (1, 11, 2, 0.5, "the Anchor"), (2, 12, 1, 0.4, None)], "query_id long, chunk_id long, rank int, score double, content string")
    anchors = spark.createDataFrame([(1, ["anchor"], []), (2, [], [])], "query_id long, phrases array<string>, strong array<string>")
    got = sorted(map(tuple, C.select_for_prompt(results, anchors, 1).collect()))
    assert got == [(1, 11, 1), (2, 12, 1)]


def test_sentence_relations_and_weak_triplets(spark):
    s = spark.createDataFrame([(1, "NoxA 禁用 in PainB"), (1, "NoxA near PainB"), (2, "NoxA 导致 PainB")], "chunk long, sentence string")
    e = spark.createDataFrame([(c, n, t) for c in (1, 2) for n, t in (("NoxA", "Drug"), ("PainB", "Disease"), ("ox", "Drug"))], "chunk long, name string, entity_type string")
    got = {tuple(r) for r in C.sentence_relations(s, e).collect()}
    assert got == {(1, "PainB", "禁忌", "NoxA"), (2, "NoxA", "副作用", "PainB"), (2, "PainB", "副作用", "NoxA")}
    passages = spark.createDataFrame([(1, "a first.\nA and B here!\nA with B again")], "passage_id long, text string")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "z")], "passage_id long, source string, target string")
    (row,) = C.weak_triplets(passages, pairs, "L").collect()
    assert (row.source, row.relation, row.target, row.evidence.strip()) == ("a", "L", "b", "A and B here!")


def test_candidates_against_plain_patterns(spark):
    """F4 on whole texts: Python's patterns, cleaning and order."""
    import re

    from quillgraph.functions import lexicons as L

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").where("text is not null").limit(150).collect()
    texts = [r.text for r in rows] + ["Neo4j and GraphRAG, ABC-12 Hepatitis; eGFR >= 30 and HbA1c < 7.5 % The", "阿司匹林药物 100", ""]

    def cleaned(c):
        c = re.sub(r"\s+", " ", c).strip(" ,.;:()[]{}，。；：、")
        for p in (r"^(?:[-*•]+|[—–]+|>)+\s*", r"\s*(?:[-*•]+|[—–]+|>)+$", r"^(?:--+|[-=]+>)\s*", r"\s*(?:--+|[-=]+>)$"):
            c = re.sub(p, "", c)
        return c.strip(" ,.;:()[]{}，。；：、")

    def plain(text):
        seen = {}
        for patterns, least in ((filters.LATIN_CANDIDATES, 3), (filters.TERM_CANDIDATES, 2), (filters.THRESHOLD_CANDIDATES, 3)):
            for p in patterns:
                for m in re.finditer(p, text):
                    c = cleaned(m.group(0))
                    if len(c) >= least and c.lower() not in L.STOP_WORDS and not re.match(r"^(?:--|->|- )", c):
                        seen.setdefault(c.lower(), c)
        return sorted(seen.values(), key=lambda c: (-len(c.split()), c.lower()))[:12]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", filters.candidate_entities(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_readers_of_dialogues_and_corpora(spark, tmp_path):
    from quillgraph.sources import readers as S

    assert S.repair_mojibake("患者".encode().decode("latin-1")) == "患者" and S.repair_mojibake("plain") == "plain" and S.repair_mojibake("漢字") == "漢字"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_bytes("Ask,Answer\n问题,\"多行\n答案\"\n".encode("gb18030"))
    (tmp_path / "y.csv").write_bytes("﻿ask,answer\nq,a\n".encode())
    (tmp_path / "z.txt").write_text("no")
    got = {r.encoding: dict(r.row) for r in S.read_dialogues(spark, f"file://{tmp_path}").collect()}
    assert got == {"gb18030": {"ask": "问题", "answer": "多行\n答案"}, "utf-8-sig": {"ask": "q", "answer": "a"}}
    assert S.split_corpus("a\r\n\r\nbb\n\nccc", 5) == ["a\n\nbb", "ccc"] and S.split_corpus("abcdef\n\ng", 4) == ["abcd", "ef", "g"] and S.split_corpus(" ", 4) == []
    (tmp_path / "c.json").write_text('{"context": "one\\n\\ntwo"}')
    assert [(r.name, r.segment, r.text) for r in S.read_corpus(spark, f"file://{tmp_path}/c.json", 4).collect()] == [("0", 0, "one"), ("0", 1, "two")]


def test_seams():
    traces = plugins.MemoryTraces(most=2, per_session=2)
    for i in range(4):
        traces.put({"trace_id": str(i), "session_id": "s"})
    assert traces.get("0") is None and traces.get("3")["trace_id"] == "3" and [t["trace_id"] for t in traces.session("s")] == ["2", "3"]
    tools = plugins.Tools()
    tools.register("echo")(lambda q: q)
    assert tools.run("echo", 5) == 5
    with pytest.raises(KeyError, match="echo"):
        tools.run("none", 1)
    with pytest.raises(ValueError):
        tools.register("echo")(lambda q: q)


def test_mention_scan_finds_what_every_pair_scores(spark, monkeypatch):
    from quillgraph.functions import text as X

    names = ["heen", "en de", "token", "ab", "x", "高血压", "Beta-Blocker", "thonti", "Is And"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("passage_id"), "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(900, "the beta blocker for 高血压 ed"), (901, None), (902, "")], "passage_id long, text string"))
    score = X.mention_score(X.text_or_empty(F.col("text")), F.array("name"))
    entities = spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((r.name, r.passage_id, r.score) for r in docs.crossJoin(entities).select("name", "passage_id", score.alias("score")).where("score > 0").collect())
    for few in (256, 0):
        monkeypatch.setattr(G, "FEW_KEYS", few)
        got = sorted((r.name, r.passage_id, r.score) for r in G.mention_scan(docs, entities).collect())
        assert got == want
    assert len({w[0] for w in want}) >= 5


def test_corpus_pieces_keep_line_ends_at_cuts(spark, tmp_path):
    from quillgraph.plans.phrase_plans import ZS
    from quillgraph.sources import readers as S

    assert S.split_corpus("abc\nd e\u00a0", 4, ZS) == ["abc\n", "d e"] and S.split_corpus("abc\nd e ", 4) == ["abc", "d e"]
    (tmp_path / "c.json").write_text('{"context": " abc\\nd e "}')
    assert [(r.segment, r.text) for r in S.read_corpus(spark, f"file://{tmp_path}/c.json", 4, ZS).collect()] == [(0, "abc\n"), (1, "d e")]


def test_dialogue_files_are_bounded(spark, tmp_path):
    from quillgraph.plans import phrase_plans

    spark.range(25_000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "concat('say \"', id, '\"\\nmore, too') AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = phrase_plans.src12_dialogue_csv(spark, f"file://{tmp_path}")
    assert len(found.inputFiles()) >= 3 and found.exceptAll(spark.read.parquet(f"file://{tmp_path}/conversations.parquet")).count() == 0 and found.count() == 25_000


def test_plugins_give_back_small_parts(spark, monkeypatch):
    import pandas as pd

    from quillgraph import plugins

    df, made = spark.createDataFrame([(1, "a b", "a")], "id long, t string, q string"), []
    assert [tuple(r) for r in plugins.relevance(df, "q", "t").select("id", "t", "q").collect()] == [(1, "a b", "a")]
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: made.append((run, schema)) or self)
    plugins.relevance(df, "q", "t")
    run, schema = made[0]
    frames = list(run(iter([pd.DataFrame({"id": range(600), "t": "a b", "q": "a", "__pair": "a\u0001a b"})])))
    assert [len(f) for f in frames] == [256, 256, 88] and "__pair" not in schema and list(frames[0].columns) == ["id", "t", "q", "relevance"]


def test_aliases_far_from_other_text(spark):
    """Text far from parentheses isn't searched for aliases, and none is found or lost by that."""
    rng = random.Random(8)
    gap = lambda: "".join(rng.choice("ab 中") for _ in range(rng.choice([1, 2, 30, 31, 32, 33, 40, 41, 42, 74, 75, 76, 120])))
    texts = ["".join(gap() + rng.choice(["(", ")", "（", "）", ",", "、"]) for _ in range(8)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    near = F.regexp_replace("text", P.FAR_FROM_PARENS, "$1\n$2")
    found = [F.regexp_extract_all(c, F.lit(P.PAREN_ALIAS), F.lit(i)) for i in (1, 2) for c in (F.col("text"), near)]
    got = rows.select(*(f.alias(f"f{i}") for i, f in enumerate(found)), F.length(near).alias("n"), F.length("text").alias("all")).collect()
    assert all(r.f0 == r.f1 and r.f2 == r.f3 for r in got) and sum(len(r.f0) for r in got) > 20 and sum(r.n for r in got) < sum(r["all"] for r in got)


def test_injected_phrases_counted_without_lists(spark):
    rows = spark.createDataFrame([("Ab", "x", 2), ("ab", "x", 2), ("aB", "x", 1), ("ab", "y", 2), ("c", "x", 1)], "phrase string, entity_type string, chunk long")
    got = {(r.name, r.entity_type): (r.n_chunks, r.chunks) for r in P.inject_phrases(rows).collect()}
    assert got == {("aB", "x"): (2, [1, 2]), ("ab", "y"): (1, [2]), ("c", "x"): (1, [1])}
    counted = P.inject_phrases(rows, lists=False)
    assert "chunks" not in counted.columns and {(r.name, r.entity_type): r.n_chunks for r in counted.collect()} == {k: n for k, (n, _) in got.items()}


def test_nearest_rows_by_strips(monkeypatch):
    """Scores of a strip of queries are held at once, never those of a whole block."""
    pd = vectors.pd
    rng = np.random.default_rng(2)
    x = [list(v) for v in rng.normal(size=(90, 4))]
    left, right = pd.DataFrame({"query_id": range(90), "left_vec": x}), pd.DataFrame({"vec_id": range(90), "right_vec": x})
    whole = [vectors._nearest(left, right, 5, t, e).values.tolist() for t in ("small", "large") for e in (False, True)]
    monkeypatch.setattr(vectors, "STRIP", 7)
    seen = []
    monkeypatch.setattr(vectors.np, "argsort", lambda a, old=np.argsort, **k: (seen.append(a.shape), old(a, **k))[1])
    assert whole == [vectors._nearest(left, right, 5, t, e).values.tolist() for t in ("small", "large") for e in (False, True)]
    assert max(n for n, _ in seen) == 7 and len(whole[1]) == 450
    assert vectors._nearest(left[:0], right, 5).empty


def test_prompt_selection_takes_no_text_to_python(spark):
    results = spark.createDataFrame([(1, 10, 1, 0.9, "The x"), (1, 11, 2, 0.5, None), (1, 12, 3, 0.1, "a TOKEN, der")], "query_id long, chunk_id long, rank int, score double, content string")
    anchors = spark.createDataFrame([(1, ["the", "Der"], ["token"])], "query_id long, phrases array<string>, strong array<string>")
    got = C.select_for_prompt(results, anchors, 2, 8000)
    want = C.prompt_selection([5, 0, 12], [{"the"}, set(), {"Der"}], [False, False, True], [0.9, 0.5, 0.1], ["the", "Der"], 2, 8000)
    assert [r.chunk_id for r in got.orderBy("place").collect()] == [[10, 11, 12][i] for i in want]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[plan.index("FlatMapGroupsInPandas") : plan.index("\n", plan.index("FlatMapGroupsInPandas"))]


def test_nearest_rows_over_blocks_with_ties_and_bad_vectors(monkeypatch):
    import numpy as np
    import pandas as pd
    from quillgraph.operators import vectors

    rng = np.random.default_rng(6)
    rows = [*rng.normal(size=(150, 5)), *[np.ones(5)] * 60, *[np.zeros(5)] * 3, np.array([np.nan] * 5), *(np.ones(5) + rng.normal(size=(30, 5)) * 1e-7)]
    ids = rng.permutation(len(rows))
    left, right = pd.DataFrame({"query_id": ids, "left_vec": rows}), pd.DataFrame({"vec_id": ids, "right_vec": rows})
    unit = vectors._matrix(right["right_vec"])
    scores = np.round(unit @ unit.T, 9)
    for gathered in (vectors.GATHERED, 100):
        monkeypatch.setattr(vectors, "GATHERED", gathered)
        for block in (4096, 16):
            monkeypatch.setattr(vectors, "BLOCK", block)
            for ties, own in (("small", False), ("large", True)):
                got = vectors._nearest(left, right, 7, ties, own).groupby("query_id")["vec_id"].apply(list).to_dict()
                sign = 1 if ties == "small" else -1
                for at, i in enumerate(ids):
                    want = sorted((p for p in range(len(ids)) if np.isfinite(scores[at, p]) and not (own and p == at)), key=lambda p: (-scores[at, p], sign * ids[p]))[:7]
                    assert got.get(i, []) == [ids[p] for p in want]


def test_a_search_has_as_few_blocks_as_its_cores_need(spark, monkeypatch):
    from quillgraph.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 2)
    rows = spark.range(400).selectExpr("id as vec_id", "array(cast(id as double), 1.0) as embedding")
    seen = spark.sparkContext.accumulator(0)
    nearest = vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", lambda *a: (seen.add(len(a[0])), nearest(*a))[1])
    assert vectors.block_top_k(rows.withColumnRenamed("vec_id", "query_id"), rows, 3).count() == 1200
    assert seen.value <= 400 * 13  # not one copy of the queries for each two vectors
