"""Row filters on texts, phrases and control state (FLT1, FLT4-FLT7, FLT16, FLT17, FLT19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X

#: Characters up to which a repeated text counts as low information, and from which its score can't be zero.
SHORT, LONG = 12, 48
MAX_BROADCAST = 100_000


def short_repeats(rows: DataFrame, text_col: str = "text", short: int = SHORT) -> DataFrame:
    """FLT4: ``rows`` with ``short_repeat``: the text with single blanks has 1 to ``short`` characters and occurs twice or more.

    Only short texts are counted, before and after the shuffle by partial sums.
    Their repeats are broadcast after a count; beyond it only short rows join.
    """
    columns = rows.columns
    squeezed = X.squeeze(X.text_or_empty(F.col(text_col)))
    keyed = rows.withColumn("__n", F.when(F.length(squeezed).between(1, short), squeezed))
    twice = keyed.where("__n is not null").groupBy("__n").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__n", F.lit(True).alias("__twice"))
    if twice.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        judged = keyed.join(F.broadcast(twice), "__n", "left")
    else:
        judged = keyed.where("__n is not null").join(twice, "__n", "left").unionByName(keyed.where("__n is null").withColumn("__twice", F.lit(False)))
    return judged.select(*columns, F.coalesce("__twice", F.lit(False)).alias("short_repeat"))


def low_information(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """FLT1: ``rows`` with ``kept``: a strong fact, or neither a short repeat nor without information; if nothing survives, everything is kept.

    A text of ``LONG`` characters with single blanks has a point for its length
    at least, so scores are computed for short texts only, and facts are looked
    for only where a row would go.
    """
    n = X.squeeze(X.text_or_empty(F.col(text_col)))
    empty = F.when(F.length(n) >= LONG, F.lit(False)).otherwise(X.information_score(n) <= 0)
    judged = short_repeats(rows, text_col).withColumn("kept", ~(F.col("short_repeat") | empty) | X.strong_fact_shape(n))
    if judged.where("kept").isEmpty():  # stops at the first survivor
        return rows.withColumn("kept", F.lit(True))
    return judged.drop("short_repeat")


def negated(text: Column, surface: Column | str, triggers: Sequence[str] = L.NEGATION_TRIGGERS, before: int = 18, after: int = 6) -> Column:
    """FLT5: a trigger stands shortly before or right after the surface in the first sentence that holds it."""
    low = F.lower(F.lit(surface) if isinstance(surface, str) else surface)
    first = F.try_element_at(F.filter(X.sentences(text, "graph"), lambda s: F.contains(F.lower(s), low)), F.lit(1))

    def test(s: Column) -> Column:
        at = F.call_function("position", low, F.lower(s))
        prefix = F.lower(F.substr(s, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before))))
        suffix = F.lower(F.substr(s, at, F.length(low) + after))
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(prefix, F.lit(t)) | F.contains(suffix, F.lit(t))
        return hit

    return F.coalesce(X.let(first, test), F.lit(False))


# Headings that are no phrases.
FRAGMENTS = ("不良反应", "处理措施", "替代方案", "关键事实", "优势", "剂量", "起效时间", "持续时间", "推荐治疗")
ARROWS = ("-", "--", "->", "-->")
MARKED = ("^(?:--|->|- )", "(?:--|->| -)$", "^[-*•>\\s]+$")


def noisy(text: Column) -> Column:
    """FLT6: blank, an arrow or a list mark, or a heading that is no phrase."""
    plain = X.name_normal(text)
    return (plain == "") | plain.isin(*ARROWS) | text.rlike("|".join(MARKED)) | F.regexp_replace(text, "\\s+", "").isin(*FRAGMENTS)


def strip_noise(t: Column) -> Column:
    """FLT6: punctuation, list marks and arrows around a candidate removed."""
    return X.without_edges(t)


# Patterns of candidates, the general ones first.
LATIN_CANDIDATES = (
    "\\b[A-Z]{2,}(?:-[A-Z0-9]+)*\\b",
    "\\b(?:[A-Z][a-z0-9]+(?:\\s+[A-Z][a-z0-9]+){0,3})\\b",
    "\\b(?:[A-Za-z]+[A-Z][A-Za-z0-9_-]+|[A-Z][a-z]+RAG|Neo4j|PageRank|GraphRAG)\\b",
    "\\b(?:[A-Za-z]+(?:itis|emia|oma|osis|pathy|plasia|penia|cytosis|genic))\\b",
)
TERM_CANDIDATES = (
    "[\u4e00-\u9fffA-Za-z0-9+-]{1,20}(?:类药物|类利尿剂|利尿剂|抑制剂|阻滞剂|激动剂|拮抗剂|单抗|药物)",
    "[\u4e00-\u9fffA-Za-z0-9+-]{1,24}(?:治疗|疗法|方案|双抗|抗凝|抗血小板治疗)",
    "[\u4e00-\u9fffA-Za-z0-9+-]{1,24}(?:支架|植入术|造影|检查)",
)
THRESHOLD_CANDIDATES = (
    "(?:[A-Za-z][A-Za-z0-9/+.-]{1,20}|[\u4e00-\u9fff]{1,12})\\s*(?:<|>|<=|>=|=|≤|≥)\\s*\\d+(?:\\.\\d+)?(?:\\s*[A-Za-z%μ/²\\-.\\d]+)?",
    "(?:至少|不低于|不超过|低于|高于)\\s*\\d+(?:\\.\\d+)?\\s*(?:个月|周|天|年|小时|分钟|mg|g|kg|ml|mL|mmol/L|mmHg|%|次/日)",
)


def candidate_entities(text: Column, most: int = 12, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """entity candidates by patterns: cleaned, no noise, the first spelling of each, most words first, then by folded name.

    Candidates of the domain patterns that stand negated in the text are left out.
    """
    t = X.text_or_empty(text)
    stops = F.array(*map(F.lit, stop_words))

    def found(patterns: Sequence[str], least: int, check: bool) -> Column:
        every = F.concat(*(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), strip_noise) for p in patterns))
        good = F.filter(F.array_distinct(every), lambda c: (F.length(c) >= least) & ~noisy(c) & ~F.array_contains(stops, X.name_normal(c)))
        return F.filter(good, lambda c: ~negated(t, c)) if check else good

    both = F.concat(found(LATIN_CANDIDATES, 3, False), found(TERM_CANDIDATES, 2, True), found(THRESHOLD_CANDIDATES, 3, True))
    keyed = F.transform(both, lambda c, i: F.struct((-F.size(F.split(c, "\\s+"))).alias("w"), F.lower(c).alias("k"), i.alias("i"), c.alias("c")))
    # of equal folded names the first; equal names have equal words, so they stand side by side once sorted
    ordered = F.array_sort(keyed)
    firsts = F.filter(ordered, lambda x, i: (i == 0) | (X.name_normal(F.get(ordered, i - 1)["c"]) != X.name_normal(x["c"])))
    return F.slice(F.transform(firsts, lambda x: x["c"]), 1, most)
