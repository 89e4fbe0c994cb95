"""The question loop over tables (X1-X3, R10, R13, SNK8, PRJ7): one bounded driver loop, every step a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import materialize
from . import policy, retrieval
from .fanout import Channel


@dataclass
class Loop:
    """Retrieve, judge, retry with the next tool; at most ``rounds`` rounds over the questions still open."""

    tools: Mapping[str, Channel]
    first: str
    second: Mapping[str, str]
    good: float = 0.85
    rounds: int = 3
    k: int = 10

    def run(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results, trace): the results of each question's best round, and a row per question and round."""
        open_ = queries.select("*", F.lit(self.first).alias("tool"))
        kept, traces = [], []
        for attempt in range(1, self.rounds + 1):
            found = [self.tools[t](open_.where(F.col("tool") == t)).select(*retrieval.RESULT) for t in self.tools]
            results = materialize(retrieval.fuse(reduce(DataFrame.unionByName, found), self.k).withColumn("attempt", F.lit(attempt)), "loop")
            signal = results.groupBy("query_id").agg(F.coalesce(F.max("score_normalized"), F.lit(0.0)).alias("signal"))
            judged = open_.join(signal, "query_id", "left").fillna(0.0, ["signal"])
            judged = materialize(judged.withColumn("verdict", F.when(F.col("signal") >= self.good, "answer").otherwise("retry")), "loop-judged")
            traces.append(judged.select("query_id", F.lit(attempt).alias("attempt"), "tool", "signal", "verdict"))
            kept.append(results)
            nxt = F.create_map(*(F.lit(x) for pair in self.second.items() for x in pair)) if self.second else None
            if nxt is None:
                break
            open_ = judged.where("verdict = 'retry'").withColumn("tool", F.try_element_at(nxt, F.col("tool"))).where("tool is not null").select(*queries.columns, "tool")
            if attempt < self.rounds and open_.isEmpty():
                break
        trace = reduce(DataFrame.unionByName, traces)
        best = trace.groupBy("query_id").agg(F.max_by("attempt", F.struct(F.col("signal"), -F.col("attempt"))).alias("attempt"))
        results = reduce(DataFrame.unionByName, kept).join(best, ["query_id", "attempt"])
        return results, trace


def explain_trace(trace: DataFrame) -> DataFrame:
    """PRJ7: one readable row per question from its trace."""
    steps = F.array_sort(F.collect_list(F.struct("attempt", "tool", "verdict", F.round("signal", 3).alias("signal"))))
    rows = trace.groupBy("query_id").agg(steps.alias("steps"))
    said = F.transform("steps", lambda s: F.concat(s["tool"], F.lit("="), s["signal"].cast("string"), F.lit(" "), s["verdict"]))
    return rows.select("query_id", (F.size("steps") - 1).alias("retries"), F.element_at("steps", -1)["verdict"].alias("status"), F.array_join(said, "; ").alias("explanation"), "steps")


def silent_sources(results: DataFrame, sources: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, source) of channels that gave a question nothing."""
    every = queries.select("query_id", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    return every.join(results.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")


def extractive_answer(facts: DataFrame, most: int = 3) -> DataFrame:
    """The answer without a model: the first facts with their citations."""
    w = Window.partitionBy("query_id").orderBy("fact_no")
    top = facts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("n", F.concat("text", F.lit(" [fact:"), F.col("fact_no").cast("string"), F.lit("]")).alias("t"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("answer"))


def caveat(summary: DataFrame) -> DataFrame:
    """A warning for questions whose claims are not all supported."""
    open_claims = F.col("claims_possible") + F.col("claims_incorrect")
    text = F.when(open_claims == 0, "").otherwise(F.format_string("%d of %d claims could not be confirmed", open_claims, F.col("claims_total")))
    return summary.withColumn("caveat", text)


def answer_questions(queries: DataFrame, results: DataFrame, passages: DataFrame) -> DataFrame:
    """R13 facade: contract facts of the results' passages, an extractive answer and its citation check."""
    rows = results.join(passages.select("chunk_id", "content"), "chunk_id")
    facts = policy.evidence_facts(rows.select("query_id", "rank", "chunk_id", "content"))
    answers = queries.select("query_id").join(extractive_answer(facts), "query_id", "left").fillna("", ["answer"])
    allowed = facts.groupBy("query_id").agg(F.collect_list(F.col("fact_no").cast("string")).alias("allowed"))
    checked = answers.join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", X.no_strings()))
    return checked.withColumn("citations", policy.citation_coverage(F.col("answer"), F.col("allowed"))).drop("allowed")
