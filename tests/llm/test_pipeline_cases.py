"""The pipeline and each of its stages on nulls, repeats, long texts, empty tables and clashing columns."""

import random
import zlib

import pytest

import corpus_pipeline as cp
from quillgraph.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, held_out string, n_words string, spans string, taken string, __row string"
CLASH = ("clash",) * 6


def rows():
    rng = random.Random(2)
    en, de = "the of and was in this with from".split(), "der die und das nicht für schön über".split()
    out = []
    for i in range(80):
        words = en if i % 2 else de
        text = " ".join(rng.choice(words) + rng.choice(["", "x", "er", "ing"]) for _ in range(rng.choice([8, 60, 150])))
        out.append((i, text, "en" if i % 2 else "de", ["a", "b", None][i % 3]))
    out += [out[3], (None, out[4][1], "de", "a"), (None, "der und die nicht allein", "de", None), (500, out[5][1], "en", "b"), (90, None, None, "a"), (91, "", "en", "a"), (92, " \n\t ", None, "b"), (93, "12 34", "en", "a")]
    out += [(94, " ".join(f"the{k}" for k in range(40_000)), "en", "a"), (95, "the leaked passage of the benchmark is here and it was long enough to see", "en", "b")]
    return [(*r, 1, *CLASH, "row") for r in out]


BENCH = [(1, "leaked passage of the benchmark is here and it was long enough"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_keep_columns_and_values(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    known = set(map(str, docs.collect()))
    if name == "shards":
        assert out.columns == [c for c in docs.columns if c not in sharding.MADE] + sharding.MADE
        assert out.count() == docs.count()
    else:
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert {str(r) for r in out.collect()} <= known


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_an_empty_table(spark, empty, name, stage):
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0


def test_whole_pipeline(spark, folder, empty):
    got = cp.run(spark, folder).collect()
    texts = [r.text for r in got]
    ids = {r.doc_id for r in got}
    assert not {90, 91, 92, 93, 95, 500} & ids and 94 in ids and None in ids
    assert all(r.score == "clash" and r["__row"] == "row" for r in got)
    assert max(map(texts.count, texts)) <= 2
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(len(got)))
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) for r in got)
    assert cp.run(spark, empty).count() == 0
    again = cp.run(spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_offsets_by_join(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, n = sharding.numbered(docs)
    two, m = sharding.numbered(docs, rows_per_bucket=5, max_broadcast=0)
    assert n == m and sorted(r.row_number for r in two.collect()) == sorted(r.row_number for r in one.collect()) == list(range(n))


def test_a_language_without_ids_or_with_one_repeated_row_is_learned(spark):
    from quillgraph.llm import langid

    en, de = "the of and was in this with from ", "der die und das nicht für schön über "
    rows = [(None, f"{en * 4} {i}", "en") for i in range(3000)] + [(7, de * 5, "de")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langs, windows, labels = langid.training_sample(docs, "text", "lang", "doc_id", per_lang=40)
    assert langs == ["de", "en"] and (labels == 0).sum() > 0 and (labels == 1).sum() >= 40
    assert langid.keep_identified(docs, per_lang=40).count() == 6000
    langs, windows, labels = langid.training_sample(docs, "text", "lang", "doc_id", per_lang=40, windows_per_lang=10, max_langs=1)
    assert langs in (["de"], ["en"]) and len(windows) <= 12


def test_training_reads_whole_rows(spark):
    from quillgraph.llm import langid

    text = "".join(chr(97 + i // 700 % 26) for i in range(12_000))
    docs = spark.createDataFrame([(1, text, "xx"), (2, "short text", "yy")], "doc_id long, text string, lang string")
    _, windows, labels = langid.training_sample(docs, "text", "lang", "doc_id")
    assert bytes(windows[labels == 0].ravel()).rstrip(b"\x00 ").decode() == text


def test_items_without_an_id_hit(spark):
    from quillgraph.llm import decontam

    passage = "one two three four five six seven eight nine ten eleven"
    items = [(None, passage), (None, passage + " twelve"), (5, "one two three"), (None, None)]
    docs = [(1, "x " + passage + " y"), (2, "clean words only"), (3, "one two three"), (None, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.brute_force(docs, items), key=str)
    for bound in (256 << 20, 0):
        got = decontam.digest(decontam.scan(d, b, keep=["doc_id"], max_broadcast_bytes=bound))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert dict((r[0], r[2]) for r in want)[1] == 11


def test_quality_trains_on_every_text_of_a_repeated_id(spark):
    from quillgraph.llm import mil_quality

    docs = spark.createDataFrame([(1, "good words here " * 40), (1, "other words " * 40), (2, "| # $ " * 90), (None, "free"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = mil_quality.fit(docs, labels)
    assert model is not None
    assert mil_quality.fit(docs, labels, max_bytes=0) is not None
