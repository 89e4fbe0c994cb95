"""Control decisions as columns: assertions, claims, gaps, verdicts, tool plans (F16, F20-F25, A36, A37, FLT16, GEN*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X

STOPS = "[。！？!?；;]|(?:，|,)(?:但|但是|然而|仍|可|却)"
#: label -> confidence, in order of precedence; ``affirmed`` is what remains.
ASSERTIONS = (("family_history", 0.9), ("speculated", 0.85), ("negated", 0.95), ("conditional", 0.8), ("historical", 0.75))


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def threshold_condition(sentence: Column) -> Column:
    return sentence.rlike("(?:<|>|<=|>=|≤|≥)\\s*\\d+(?:\\.\\d+)?") | sentence.rlike("(?:低于|高于|不低于|不超过|至少)\\s*\\d+")


def classify_assertion(sentence: Column, entity: Column, cues: Mapping[str, Sequence[str]] = L.ASSERTION_CUES, before: int = 24, after: int = 8) -> Column:
    """F16: struct(label, confidence). Cues count within ``before`` characters in front of the entity and ``after``
    behind it, cut at terminators; family cues and, with a threshold, conditional cues count anywhere."""
    at = F.position(entity, sentence)
    end = at + F.length(entity)
    prefix = F.substr(sentence, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)))
    suffix = F.substr(sentence, end, F.lit(after))
    near = F.concat(F.element_at(F.split(prefix, STOPS), -1), F.lit("\u0001"), F.element_at(F.split(suffix, STOPS), 1))
    label, score = F.lit("affirmed"), F.lit(0.7)
    for name, confidence in reversed(ASSERTIONS):
        hit = _holds_any(near, cues[name])
        if name == "family_history":
            hit = hit | _holds_any(sentence, cues[name])
        if name == "conditional":
            hit = hit | (threshold_condition(sentence) & _holds_any(sentence, cues[name]))
        label, score = F.when(hit, name).otherwise(label), F.when(hit, confidence).otherwise(score)
    return F.struct(F.when(at > 0, label).otherwise("affirmed").alias("label"), F.when(at > 0, score).otherwise(0.5).alias("confidence"))


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, level, failure, chunk_id) for claims(claim_id, entities, numbers, actions) against
    evidence(claim_id, pos, chunk_id, content): the first evidence row that decides."""
    normal = F.transform("entities", X.hard_normal)
    hard = X.quantitative_facts(F.concat_ws(" ", F.array_join("numbers", " "), F.array_join("actions", " ")))
    c = claims.select("claim_id", F.filter(normal, lambda t: t != "").alias("terms"), hard.alias("facts"), "actions")
    plain = F.filter("actions", lambda a: F.size(X.quantitative_facts(a)) == 0)
    asked = F.when(F.size("facts") == 0, plain).otherwise(F.filter(plain, lambda a: ~_holds_any(X.hard_normal(a), L.MEASUREMENT_CUES)))
    c = c.withColumn("asked", asked)
    rows = c.join(evidence, "claim_id").withColumn("low", X.hard_normal(F.col("content"))).withColumn("ef", X.quantitative_facts(F.col("content")))
    rows = rows.where(F.forall("terms", lambda t: F.contains("low", t)))
    missing = F.size(F.array_except("facts", "ef")) > 0
    supports = F.exists(
        "asked",
        lambda a: F.contains("low", X.hard_normal(a))
        | (_holds_any(X.hard_normal(a), L.PROHIBITIONS) & _holds_any(F.col("low"), L.PROHIBITIONS))
        | (F.contains(X.hard_normal(a), F.lit("改用")) & F.contains("low", F.lit("改用"))),
    )
    verdict = (
        F.when(missing & X.conflicting_facts(F.col("facts"), F.col("ef")), F.struct(F.lit("incorrect").alias("level"), F.lit("hard_fail").alias("failure")))
        .when(missing, F.lit(None))
        .when((F.size("asked") == 0) | supports, F.struct(F.lit("correct").alias("level"), F.lit("none").alias("failure")))
        .otherwise(F.struct(F.lit("possible_correct").alias("level"), F.lit("soft_fail").alias("failure")))
    )
    rows = rows.withColumn("v", verdict).where("v is not null")
    first = rows.groupBy("claim_id").agg(F.min_by(F.struct("v.level", "v.failure", "chunk_id"), "pos").alias("d"))
    full = claims.select("claim_id").join(first, "claim_id", "left")
    return full.select("claim_id", F.coalesce("d.level", F.lit("possible_correct")).alias("level"), F.coalesce("d.failure", F.lit("hard_fail")).alias("failure"), F.coalesce("d.chunk_id", F.lit("")).alias("chunk_id"))


def verification_summary(checked: DataFrame, key: str) -> DataFrame:
    """Counters by level and the step's status."""
    n = lambda level: F.count_if(F.col("level") == level)
    status = F.when(n("incorrect") > 0, "retry_required").when(n("possible_correct") > 0, "partial").otherwise("passed")
    return checked.groupBy(key).agg(F.count(F.lit(1)).alias("claims_total"), n("correct").alias("claims_supported"), n("possible_correct").alias("claims_possible"), n("incorrect").alias("claims_incorrect"), status.alias("status"))


def citation_coverage(answer: Column, allowed: Column) -> Column:
    """struct(cited, known, unknown, status) of [fact:id] marks."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[fact:([^\\]]+)\\]"), F.lit(1)))
    known, unknown = F.array_sort(F.array_intersect(cited, allowed)), F.array_sort(F.array_except(cited, allowed))
    return F.struct(F.size(cited).alias("cited"), F.size(known).alias("known"), F.size(unknown).alias("unknown"), F.when((F.size(cited) > 0) & (F.size(unknown) == 0), "passed").otherwise("partial").alias("status"))


def gap_type(n_numbers: Column, text: Column, n_entities: Column) -> Column:
    """F22."""
    return F.when((n_numbers > 0) | text.rlike("\\d"), "missing_numeric_fact").when(n_entities > 0, "missing_entity").otherwise("missing_relation")


def correction_tool(gap: Column) -> Column:
    """the tool that a first gap calls for."""
    return F.when(gap == "missing_numeric_fact", "bm25_search").when(gap == "missing_entity", "hybrid_search").otherwise("cypher_traverse")


def verdict(step: Mapping[str, Column]) -> Column:
    """one control verdict from a reflection's enum fields."""
    low = {k: F.lower(F.trim(F.coalesce(v, F.lit("")))) if k not in ("should_retry", "should_rerank_again") else v for k, v in step.items()}
    return (
        F.when(low["verdict"].isin("answer", "retry", "rerank", "stop"), low["verdict"])
        .when(low["retry_scope"] == "rerank_only", "rerank")
        .when((low["retry_scope"] == "stop") | ~low["should_retry"], "stop")
        .when(low["failure_type"] == "acceptable", "answer")
        .when((low["recommended_action"] == "answer_ready") & (low["failure_type"] == ""), "answer")
        .when(low["retry_scope"].isin("provider_refresh", "tool_escalation"), "retry")
        .when(low["should_rerank_again"] & (low["retry_scope"] == ""), "rerank")
        .otherwise("retry")
    )


GAP_TOOLS = {
    "missing_numeric_threshold": ["bm25_search", "vector_search"],
    "missing_diagnostic_criterion": ["bm25_search", "vector_search"],
    "missing_relation": ["cypher_traverse", "hybrid_search"],
    "missing_treatment_option": ["cypher_traverse", "hybrid_search"],
    "missing_entity": ["hybrid_search", "vector_search"],
    "missing_comparison_target": ["hybrid_search", "comprehensive_search"],
    "conflicting_evidence": ["hybrid_search", "comprehensive_search"],
}


def next_tool(gap: Column, required: Column, tried: Column) -> Column:
    """the first untried tool of the required one and the gap's list; null if none is left."""
    by_gap = F.create_map(*(x for g, tools in GAP_TOOLS.items() for x in (F.lit(g), F.array(*map(F.lit, tools)))))
    wanted = F.when(F.coalesce(required, F.lit("none")).isin("", "none"), X.no_strings()).otherwise(F.array(required))
    options = F.array_distinct(F.concat(wanted, F.coalesce(F.try_element_at(by_gap, gap), X.no_strings())))
    return F.try_element_at(F.array_except(options, tried), F.lit(1))


NEED_TOOLS = (("semantic_passage", "vector_search"), ("exact_numeric", "bm25_search"), ("graph_relation", "cypher_traverse"), ("temporal_evidence", "temporal_query"), ("broad_recall", "comprehensive_search"))


def tool_plan(suggested: Column, needs: Column, strong_anchor: Column, most: int = 2) -> Column:
    """the router's tool, those of the needs in their order, BM25 for a strong anchor; at most ``most``."""
    mapped = F.array_compact(F.array(*(F.when(F.array_contains(needs, n), t) for n, t in NEED_TOOLS)))
    every = F.array_distinct(F.concat(F.array(suggested), mapped, F.when(strong_anchor, F.array(F.lit("bm25_search"))).otherwise(X.no_strings())))
    return F.slice(every, 1, most)


def prompt_order(results: DataFrame, key: str = "query_id") -> DataFrame:
    """GEN2: best evidence at both ends: odd places in order, then even places reversed."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "rank")
    rows = results.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    place = F.when(F.col("__n") <= 2, F.col("__i")).when(F.col("__i") % 2 == 0, F.col("__i") / 2).otherwise(F.col("__n") - (F.col("__i") + 1) / 2)
    return rows.withColumn("place", place.cast("int")).drop("__i", "__n")


def evidence_facts(results: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, fact_no, text, chunk_id): sentences with a number from results in rank order, once each ignoring case."""
    rows = results.select("query_id", "rank", "chunk_id", F.posexplode(X.sentences(F.col("content"))).alias("i", "s")).where(F.col("s").rlike("\\d"))
    rows = rows.withColumn("s", X.squeeze(F.col("s"))).withColumn("k", X.fold(F.col("s")))
    first = rows.groupBy("query_id", "k").agg(F.min(F.struct("rank", "i", "chunk_id", "s")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.rank", "f.i", "k")
    return first.withColumn("fact_no", F.row_number().over(w)).where(F.col("fact_no") <= most).select("query_id", "fact_no", F.left("f.s", F.lit(500)).alias("text"), "f.chunk_id")
