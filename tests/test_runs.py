"""Dataset and run operators on worked cases: nulls, repeats, wrong rows, empty tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillgraph.operators import runs as U
from quillgraph.sources import readers as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_modes(spark):
    asked = spark.createDataFrame([(1,)], "query_id long")
    modes = {"a": lambda q: q, "b": lambda q: q.where("false")}
    assert [tuple(r) for r in U.run_modes(asked, modes).collect()] == [(1, "a")]
    with pytest.raises(ValueError, match="nope"):
        U.run_modes(asked, modes, ["nope"])


def test_resuming_counts_null_keys(spark):
    work = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id long, mode string")
    done = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, mode string")
    assert [r.id for r in U.unfinished(work, done, ["id", "mode"]).collect()] == [3]
    assert U.unfinished(work, done.limit(0), ["id", "mode"]).count() == 3


def test_gold_rows_are_validated(spark):
    schema = "id long, text string, entity string, start int, end int, gold_label string, weak_label string, source string"
    good = spark.createDataFrame([(1, "a drug", "drug", None, None, "negated", "affirmed", "s"), (2, "a drug", "drug", 2, 6, " affirmed", None, None), (3, "x", "y", None, None, "", None, None)], schema)
    got = {r.id: (r.label, r.start, r.end, r.source, r.weak_label_changed) for r in U.compile_gold(good).collect()}
    assert got == {1: ("negated", 2, 6, "gold_review:1:s", True), 2: ("affirmed", 2, 6, "gold_review:2:", False)}
    for wrong in ((1, "a drug", "drug", 0, 4, "negated", None, None), (1, "a drug", "pill", None, None, "negated", None, None), (1, "a drug", "drug", None, None, "maybe", None, None)):
        with pytest.raises(PySparkException, match="bad gold row 1"):
            U.compile_gold(spark.createDataFrame([wrong], schema)).collect()


def test_record_spans(spark):
    schema = "id long, text string, entities array<struct<entity:string,start_idx:int,end_idx:int>>, spo array<struct<subject:string,object:string>>"
    rows = spark.createDataFrame([(1, "flu and cold", [("flu", 0, 2), (None, 8, 11), ("far", 90, 92)], None), (2, "flu and cold", None, [("flu", "cold"), ("none", None)]), (3, " mention ", [], []), (4, None, None, None)], schema)
    got = sorted((r.id, r.entity, r.start, r.end) for r in U.spans_of_records(rows).collect())
    assert got == [(1, "cold", 8, 12), (1, "flu", 0, 3), (3, "mention", 0, 7)]


def test_ratings(spark):
    cases = {'{"rating": 2}': 2.0, '{"score": "1"}': 1.0, "[0]": 0.0, "[0, 1]": None, '{"rating": 3}': None, "I say 2": 2.0, "": None, "7": None}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", U.rating(F.col("a")).alias("r")).collect()
    assert {r.a: r.r for r in rows} == cases
    r = one(spark, U.relevance_of(F.lit(2.0), F.lit(None).cast("double")).alias("a"), U.relevance_of(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("b"), U.attributed_share(F.lit("[]")).alias("c"), U.attributed_share(F.lit("no")).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (1.0, None, None, None)


def test_lines_frames_pieces(spark):
    r = one(
        spark,
        U.plain_lines(F.lit("## Head \n - item\n\nplain")).alias("l"),
        U.sse_frame(F.lit("token"), F.lit("a\nb")).alias("f"),
        U.stream_pieces(F.lit("abcdefg"), 3).alias("p"),
        U.stream_pieces(F.lit(""), 3).alias("none"),
        F.transform(S.markdown_tables(F.lit("x\n| a | b |\n|---|---|\n| 1 | 2,3 |\n\ny | z")), S.table_csv).alias("t"),
    )
    assert r.l == ["Head", "• item", "", "plain"] and r.f == "event: token\ndata: a\ndata: b\n\n"
    assert r.p == ["abc", "def", "g"] and r.none == [] and r.t == ['a,b\n1,"2,3"']


def test_synthetic_samples(spark):
    t = spark.createDataFrame([("n", "no {entity}!"), ("x", "none")], "label string, template string")
    s = spark.createDataFrame([("flu",), ("flu",)], "entity string")
    assert [tuple(r) for r in U.synthetic_samples(t, s).collect()] == [("n", "no flu!", "flu", 3, 6)]
