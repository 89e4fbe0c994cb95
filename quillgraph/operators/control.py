"""Control state, sets, contexts and roll-ups (A10, A14, A15, A22, A29, FLT16, FLT17, FLT19, GEN1, GEN3, GEN5, S3-S7, W9, X5, X8)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def repeated_retry(rows: DataFrame, key: str, order: str, tool: str) -> DataFrame:
    """FLT16: ``rows`` with ``blocked``: the tool is the one just tried in the session."""
    return rows.withColumn("blocked", F.coalesce(F.col(tool) == F.lag(tool).over(Window.partitionBy(key).orderBy(order)), F.lit(False)))


def within_budgets(rows: DataFrame, key: str, order: str, cost: str, calls: int, total: float) -> DataFrame:
    """FLT17: ``rows`` with within_calls and within_time, counted from the session's start."""
    w = Window.partitionBy(key).orderBy(order)
    spent = F.round(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)
    return rows.withColumn("within_calls", F.row_number().over(w) <= calls).withColumn("within_time", spent <= total)


def temporal_filter(edges: DataFrame, at: str, start: Column, end: Column, name: Column, limit: int, ties: str) -> DataFrame:
    """FLT19: edges from ``start`` to before ``end`` that pass the name test, newest first."""
    return edges.where((F.col(at) >= start) & (F.col(at) < end) & name).orderBy(F.desc(at), ties).limit(limit)


def overlaps(values: Column, wanted: Column) -> Column:
    """S3: the sets share a value; empty sets share none."""
    return F.coalesce(F.arrays_overlap(values, wanted), F.lit(False))


def citation_sets(cited: Column, allowed: Column) -> Column:
    """struct(known, unknown): cited ids that are allowed, and those that are not."""
    return F.struct(F.array_intersect(cited, allowed).alias("known"), F.array_except(cited, allowed).alias("unknown"))


def is_subset(part: Column, whole: Column) -> Column:
    """Every value of ``part`` is in ``whole``."""
    return F.size(F.array_except(part, whole)) == 0


def first_of_bag(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; versions merge before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def cache_plan(asked: Column, cached: Column) -> Column:
    """struct(reused, executed) of asked channels, each sorted."""
    return F.struct(F.sort_array(F.array_intersect(asked, cached)).alias("reused"), F.sort_array(F.array_except(asked, cached)).alias("executed"))


def channel_priority(name: Column, order: Sequence[str]) -> Column:
    """The place of a channel in ``order``; unknown ones come last."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, i))), name), F.lit(len(order)))


def route(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """The deterministic router: every question is simple and goes to vector search."""
    return queries.withColumn("query_type", F.lit("simple")).withColumn("confidence", F.lit(0.5)).withColumn("suggested_tool", F.lit("vector_search"))


def ordered_join(rows: DataFrame, key: str, order: str | Sequence[str], text: Column, glue: str, most: int | None = None) -> DataFrame:
    """GEN1, GEN3: (key, text): a group's lines in order, joined; at most ``most`` of them, ranked before they are collected."""
    names = [order] if isinstance(order, str) else list(order)
    lines = rows.select(key, *names, text.alias("__t"))
    if most is not None:
        w = Window.partitionBy(key).orderBy(*names, "__t")
        lines = lines.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names, "__t"))), lambda x: x["__t"]), glue).alias("text"))


def expand_aliases(text: Column, group: Sequence[str]) -> Column:
    """GEN5: the missing members of an alias group appended to a text that holds one of them."""
    members = F.array(*map(F.lit, group))
    missing = F.filter(members, lambda a: ~F.contains(text, a))
    return F.when(F.exists(members, lambda a: F.contains(text, a)) & (F.size(missing) > 0), F.concat_ws(" ", text, F.array_join(missing, " "))).otherwise(text)


def project_rank(links: DataFrame, ranks: DataFrame, entity: str, node: str) -> DataFrame:
    """A10: (entity, score): the largest rank of an entity's nodes over the largest of all. ``ranks(node, rank)``."""
    top = ranks.agg(F.max("rank").alias("top"))
    best = links.join(ranks, node).groupBy(entity).agg(F.max("rank").alias("rank"))
    return best.join(F.broadcast(top), F.lit(True)).select(entity, F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("score"))


def promoted_aliases(observations: DataFrame, least: int = 2) -> DataFrame:
    """(entity, alias, n_chunks) seen in ``least`` distinct chunks or more; repeats go before the count is shuffled."""
    once = observations.select("entity", "alias", "chunk").distinct()
    return once.groupBy("entity", "alias").agg(F.count("chunk").alias("n_chunks")).where(F.col("n_chunks") >= least)


def merge_candidates(candidates: DataFrame, source: str = "source") -> DataFrame:
    """Per (chunk, phrase) the sorted sources and the number of observations."""
    return candidates.groupBy("chunk", "phrase").agg(F.sort_array(F.collect_set(source)).alias("sources"), F.count(F.lit(1)).alias("n"))


def detection_counts(rows: DataFrame, found: Column, expected: Column) -> DataFrame:
    """One row tp, fp, tn, fn."""
    return rows.agg(F.count_if(found & expected).alias("tp"), F.count_if(found & ~expected).alias("fp"), F.count_if(~found & ~expected).alias("tn"), F.count_if(~found & expected).alias("fn"))


def monitor(rows: DataFrame, key: str, value: str, high: float = 0.3, low: float = 0.05) -> DataFrame:
    """(key, n, mean_value, share, advice) of tools or query types."""
    t = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    t = t.join(F.broadcast(t.agg(F.sum("n").alias("__total"))), F.lit(True)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")
    return t.withColumn("advice", F.when(F.col("share") > high, "raise cache").when(F.col("share") < low, "drop tool").otherwise("keep"))


def greedy_total(sizes: Column, most: int) -> Column:
    """W9's budget pass: the total of the pieces that fit one after the other; one that does not fit is passed over."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, v: F.when(a + v <= most, a + v).otherwise(a))


def prompt_selection(lengths: list[int], hits: list[set[str]], strong: list[bool], scores: list[float], anchors: list[str], most: int = 10, chars: int = 18_000) -> list[int]:
    """Places of the results a prompt takes, in order.

    Results rank by covered phrase anchors, strong anchors, score and place.
    Each anchor that is not covered yet first takes its best result; then the
    rest follow while they fit.  The first one always fits.
    """
    ranked = sorted(range(len(lengths)), key=lambda i: (-len(hits[i]), not strong[i], -scores[i], i))
    chosen: list[int] = []
    covered: set[str] = set()
    used = 0

    def take(i: int) -> bool:
        nonlocal used
        if i in chosen or len(chosen) >= most or (chosen and used + lengths[i] > chars):
            return False
        chosen.append(i)
        covered.update(hits[i])
        used += lengths[i]
        return used >= chars

    for anchor in anchors:
        best = next((i for i in ranked if anchor in hits[i]), None)
        if anchor not in covered and best is not None:
            take(best)
        if len(chosen) >= most or used >= chars:
            return chosen
    for i in ranked:
        if take(i):
            break
    return chosen or ranked[:1]


def select_for_prompt(results: DataFrame, anchors: DataFrame, most: int = 10, chars: int = 18_000) -> DataFrame:
    """(query_id, chunk_id, place) of results(query_id, chunk_id, rank, score, content) for anchors(query_id, phrases, strong).

    One group holds one question's results, which its search has bounded: of each
    its length, the phrases it holds and whether a strong form is there, not its text.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        picked = prompt_selection(rows["n"].tolist(), [set(h) for h in rows["hits"]], rows["sure"].tolist(), rows["score"].tolist(), list(rows["phrases"].iloc[0]), most, chars)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[picked].to_numpy(), "chunk_id": rows["chunk_id"].iloc[picked].to_numpy(), "place": range(1, len(picked) + 1)})

    text = F.coalesce("content", F.lit(""))

    def told(low):
        held = lambda p: F.contains(low, F.lower(p))
        return F.struct(F.filter("phrases", held).alias("hits"), F.exists("strong", held).alias("sure"))

    joined = results.join(anchors, "query_id").withColumn("__t", X.let(F.lower(text), told))
    joined = joined.select("query_id", "chunk_id", "rank", "score", "phrases", F.length(text).alias("n"), "__t.hits", "__t.sure")
    return joined.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, place int")


# What a sentence says about two entities in it, and the relations whose target must be a means of treatment.
RELATION_PATTERNS = (
    ("禁忌", "(禁忌|禁用|避免|慎用)"),
    ("替代", "(改用|换用|替代)"),
    ("疗程", "(至少|持续|疗程|多久|月|周|天)"),
    ("剂量", "(剂量|用量|每[日周天]|mg|g|ml|mL|U/)"),
    ("副作用", "(副作用|不良反应|导致|引起)"),
    ("推荐", "(首选|推荐|适用|用于)"),
)
MEANS_ONLY = ("禁忌", "替代", "推荐", "剂量")
MEANS = ("Drug", "DrugClass", "Therapy", "Threshold", "Device")


def sentence_relation(sentence: Column, patterns: Sequence[tuple[str, str]] = RELATION_PATTERNS) -> Column:
    """The first relation whose pattern the sentence holds, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def sentence_relations(sentences: DataFrame, entities: DataFrame, patterns: Sequence[tuple[str, str]] = RELATION_PATTERNS, means_only: Sequence[str] = MEANS_ONLY) -> DataFrame:
    """Distinct (chunk, source, relation_type, target) of ordered entity pairs in a sentence with a relation pattern.

    ``sentences(chunk, sentence)``; ``entities(chunk, name, entity_type)``.  Only
    sentences with a pattern meet entities, and only those of their own chunk; a
    sentence's pairs come from the entities in it.
    """
    told = sentences.withColumn("relation_type", sentence_relation(F.col("sentence"), patterns)).where("relation_type is not null")
    here = told.join(entities, "chunk").where(X.contains_surface(F.col("sentence"), F.col("name")))
    grouped = here.groupBy("chunk", "sentence", "relation_type").agg(F.collect_set(F.struct("name", "entity_type")).alias("present")).where(F.size("present") > 1)
    pairs = grouped.select("chunk", "relation_type", F.explode("present").alias("a"), "present").select("chunk", "relation_type", "a", F.explode("present").alias("b"))
    pairs = pairs.where((F.col("a.name") != F.col("b.name")) & (~F.col("relation_type").isin(*means_only) | F.col("b.entity_type").isin(*MEANS)))
    return pairs.select("chunk", F.col("a.name").alias("source"), "relation_type", F.col("b.name").alias("target")).distinct()


def weak_triplets(passages: DataFrame, pairs: DataFrame, label: str, terms: Sequence[str] = (), intents: Sequence[str] = ()) -> DataFrame:
    """(source, relation, target, passage_id, evidence): for pairs(passage_id, source, target) the first sentence of the passage that supports them.

    It holds both names, one intent word where there are any, and two of the terms
    where there are any; names and words are compared in folded case.
    """
    low = F.col("low")
    test = F.contains(low, X.fold(F.col("source"))) & F.contains(low, X.fold(F.col("target")))
    if intents:
        test = test & F.exists(F.array(*map(F.lit, intents)), lambda t: F.contains(low, t))
    if terms:
        test = test & (F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))) >= 2)
    split = passages.select("passage_id", F.posexplode(X.sentences(F.col("text"), "evidence")).alias("at", "sentence")).withColumn("low", X.fold("sentence"))
    rows = split.join(pairs, "passage_id").where(test)
    first = rows.groupBy("source", "target", "passage_id").agg(F.min_by("sentence", "at").alias("evidence"))
    return first.select("source", F.lit(label).alias("relation"), "target", "passage_id", "evidence")
