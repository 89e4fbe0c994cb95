"""Stemming, statement alignment, the learned assertion classifier and merged tables."""

import glob
import hashlib
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.stemming import stem, stemmed
from quillgraph.operators import alignment as AL
from quillgraph.operators import assertion_model as AM
from quillgraph.operators import entities as E
from quillgraph.operators import runs as U
from quillgraph.sources import merged as S

#: Examples of the published description.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil is is by by""".split()


def test_stems_of_the_published_examples(spark):
    pairs = list(itertools.batched(STEMS, 2))
    assert [(w, stem(w)) for w, _ in pairs] == pairs
    rows = spark.createDataFrame([(w, s) for w, s in pairs] + [(None, None)], "w string, s string")
    assert rows.where(~stemmed(F.col("w")).eqNullSafe(F.col("s"))).count() == 0


def test_rouge_l_with_stems_equals_a_plain_table():
    def plain(a, b):
        a, b = ([stem(w) if len(w) > 3 else w for w in t.lower().split()] for t in (a, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 2 * best[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    rng = random.Random(5)
    words = ["the", "run", "running", "runs", "treatment", "treated", "treats", "hopeful", "hopes", "of"]
    for _ in range(60):
        a, b = (" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(2))
        assert E.rouge_l(a, b) == pytest.approx(plain(a, b))
    assert E.rouge_l("the treated patients", "the treatment of patient") > E.rouge_l("the treated patients", "the treatment of patient", stemming=False)


@pytest.mark.parametrize("seed", range(8))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    for rows, columns in itertools.product(range(1, 6), range(1, 6)):
        gain = rng.integers(0, 4, (rows, columns)) / 4 if seed % 2 else rng.random((rows, columns))
        to = AL.assign(gain)
        used = to[to >= 0]
        assert len(set(used)) == len(used) == min(rows, columns)
        few = gain if rows <= columns else gain.T
        best = max(sum(few[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(few.shape[1]), few.shape[0]))
        assert gain[np.flatnonzero(to >= 0), used].sum() == pytest.approx(best)
    assert AL.assign(np.zeros((3, 0))).tolist() == [-1, -1, -1]


def test_statements_are_supported_once(spark):
    rows = [
        (1, "Aspirin lowers fever. Aspirin lowers fever. It rains.", "Aspirin lowers the fever. Nothing else here."),
        (2, "", "Some evidence."),
        (3, None, None),
        (4, "发热用阿司匹林。", "阿司匹林治发热。天气好。"),
    ]
    got = {r.id: r for r in AL.align(spark.createDataFrame(rows, "id long, a string, e string"), F.col("a"), F.col("e"), ["id"]).collect()}
    assert (got[1].n_statements, got[1].n_evidence, got[1].n_supported) == (3, 2, 1)
    assert got[1].precision == pytest.approx(1 / 3) and got[1].recall == 0.5 and got[1].f_beta == pytest.approx(0.4)
    assert got[2].f_beta == got[3].f_beta == 0 and got[2].n_evidence == 1
    assert got[4].n_supported == 1 and got[4].recall == 0.5


TEMPLATES = [
    ("negated", "患者否认{entity}。"), ("negated", "未见{entity}"), ("negated", "无明显{entity}"), ("speculated", "不能排除{entity}"), ("speculated", "可能为{entity}"), ("speculated", "疑似{entity}待查"),
    ("affirmed", "{entity}已确诊"), ("affirmed", "患者有{entity}"), ("affirmed", "目前{entity}明显"), ("historical", "既往{entity}病史"), ("historical", "曾患{entity}"),
]
#: Sentences of a kind that is in no template and on which the rules are silent.
UNSEEN = [("negated", "病人没出现过{entity}"), ("affirmed", "今晨{entity}")]


def test_the_model_and_its_guard_on_held_out_samples(spark, sf):
    slots = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand").alias("entity"))
    samples = U.synthetic_samples(spark.createDataFrame(TEMPLATES, "label string, template string"), slots).select("text", "entity", "label").cache()
    held_out = F.pmod(F.xxhash64("entity"), F.lit(5)) == 0
    model = AM.fit(samples.where(~held_out))
    assert model.labels == ["affirmed", "historical", "negated", "speculated"]
    rows = AM.accuracy(samples.where(held_out), model).collect()
    n, alone, guarded = (sum(r[c] for r in rows) for c in ("n", "model_correct", "guarded_correct"))
    assert n > 100 and alone / n > 0.95 and guarded / n > 0.95
    new = U.synthetic_samples(spark.createDataFrame(UNSEEN, "label string, template string"), slots).select("text", "entity", "label")
    assert AM.guarded(new, model).groupBy("labeler").count().count() >= 1


def test_classifier_edge_cases(spark):
    rows = spark.createDataFrame([("a b", "b", "x"), (None, None, "x"), ("c", "d", None)], "text string, entity string, label string")
    only = AM.fit(rows)
    assert only.labels == ["x"] and {r.model_label for r in only.predict(rows, "text", "entity").collect()} == {"x"}
    none = AM.fit(rows.where("false"))
    assert none.labels == [] and {r.model_label for r in none.predict(rows, "text", "entity").collect()} == {None}
    two = AM.fit(spark.createDataFrame([("no fever", "fever", "neg"), ("has fever", "fever", "pos")] * 20, "text string, entity string, label string"))
    asked = spark.createDataFrame([("no fever", "fever"), ("has fever", "fever"), (None, "x"), ("", "")], "text string, entity string")
    assert [r.model_label for r in two.predict(asked, "text", "entity").collect()][:2] == ["neg", "pos"]
    assert set(AM.guarded(asked, two).columns) == {"text", "entity", "model_label", "model_confidence", "label", "confidence", "labeler"}


def files_of(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.range(2000).select("id", F.concat(F.lit("v"), "id").alias("name"), F.lit(1).alias("version"))
    assert len(S.merge_into(path, first, ["id"], ["version"], 16)) == 16
    before = files_of(path)
    updates = spark.createDataFrame([(5, "old", 2), (5, "new", 3), (9999, "fresh", 1), (None, "no key", 1)], "id long, name string, version int")
    touched = S.merge_into(path, updates, ["id"], ["version"], 16)
    after = files_of(path)
    untouched = {f for f in before if int(f.split(f"{S.BUCKET}=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 3 and len(untouched) == 16 - len(touched)
    assert all(after.get(f) == before[f] for f in untouched) and not (set(before) - untouched) & set(after)
    rows = {r.id: r.name for r in S.read_merged(spark, path).collect()}
    assert len(rows) == 2002 and rows[5] == "new" and rows[9999] == "fresh" and rows[None] == "no key" and rows[6] == "v6"
    assert S.merge_into(path, updates.where("false"), ["id"], ["version"], 16) == [] and files_of(path) == after


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    S.merge_into(path, spark.range(100).select("id", F.lit("a").alias("name")), ["id"], ["name"], 8)
    before = files_of(path)
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken row")).cast("string")).otherwise("b").alias("name"))
    with pytest.raises(Exception, match="broken row"):
        S.merge_into(path, bad, ["id"], ["name"], 8)
    assert files_of(path) == before and not [p for p in os.listdir(path) if p.startswith(".spark-staging")]
    assert {r.name for r in S.read_merged(spark, path).collect()} == {"a"}


def test_new_columns_and_skipped_updates(spark, tmp_path):
    path = str(tmp_path / "table")
    S.merge_into(path, spark.createDataFrame([(1, "a")], "id long, name string"), ["id"], ["name"], 4)
    more = spark.createDataFrame([(1, "b", [1.0]), (2, "c", []), (3, "d", None)], "id long, name string, embedding array<double>")
    S.merge_into(path, more, ["id"], ["name"], 4, skip="coalesce(size(embedding), 0) <= 0")
    assert {(r.id, r.name) for r in S.read_merged(spark, path).collect()} == {(1, "b")}


@pytest.mark.parametrize("name", ["f5_injected_phrases", "f7_structural_phrases", "f17_assertion_candidates", "f20_claim_checks"])
def test_heavy_rows_of_one_split_are_dealt(spark, sf, name):
    """The part table is one split at any of the given sizes; its heavy rows must not be one task's."""
    plan = __import__("__spark_entry__").queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
