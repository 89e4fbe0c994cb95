"""Lexical retrieval, confidence, de-duplication and channel fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from . import tfidf

RESULT = ["query_id", "chunk_id", "score", "score_normalized", "rank", "source"]


# Words that are no anchors of a lexical query.
ANCHOR_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "described", "did", "do",
    "does", "during", "events", "for", "from", "had", "has", "have", "he", "her",
    "him", "his", "how", "in", "into", "is", "it", "its", "of", "on", "or",
    "recorded", "that", "the", "their", "them", "there", "these", "this", "those",
    "to", "was", "were", "what", "when", "where", "which", "who", "with",
    "diary", "daily", "account",
)
TITLE_PHRASE = "\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b"
ANCHOR_TOKEN = "[\\u4e00-\\u9fff]+|[A-Za-z0-9_-]+"


def anchors(text: Column) -> Column:
    """struct(required, optional) of a question's lexical anchors.

    Tokens of three characters or more are required, four at most, and two title
    phrases are optional; without tokens, two phrases are required.  A token that
    a phrase holds is no anchor of its own.
    """
    held = lambda words: F.filter(words, lambda w: ~F.lower(w).isin(*ANCHOR_STOP_WORDS))
    phrases = F.transform(F.regexp_extract_all(text, F.lit(TITLE_PHRASE), F.lit(0)), lambda p: held(F.split(p, "\\s+")))
    blank = F.struct(X.no_strings().alias("phrases"), X.no_strings().alias("seen"))

    def add(so_far: Column, words: Column) -> Column:
        phrase = F.array_join(words, " ")
        more = F.struct(F.array_append(so_far["phrases"], phrase).alias("phrases"), F.concat(so_far["seen"], F.array(F.lower(phrase)), F.transform(words, F.lower)).alias("seen"))
        return F.when((F.size(words) == 0) | F.array_contains(so_far["seen"], F.lower(phrase)), so_far).otherwise(more)

    def split(found: Column) -> Column:
        tokens = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ANCHOR_TOKEN), F.lit(0)), F.lower))
        tokens = F.filter(held(tokens), lambda t: (F.length(t) > 2) & ~F.array_contains(found["seen"], t))
        return X.let(tokens, lambda t: F.when(F.size(t) > 0, F.struct(F.slice(t, 1, 4).alias("required"), F.slice(found["phrases"], 1, 2).alias("optional"))).otherwise(F.struct(F.slice(found["phrases"], 1, 2).alias("required"), X.no_strings().alias("optional"))))

    return X.let(F.aggregate(phrases, blank, add), split)


def anchor_order(results: DataFrame, content: Column, required: Column) -> DataFrame:
    """R3's local order: ``results`` ranked anew by the share of required anchors in ``content``, how near their first places are, then score and rank."""
    low = F.lower(content)
    places = F.filter(F.transform(required, lambda a: F.call_function("instr", low, F.lower(a))), lambda p: p > 0)
    rows = results.withColumn("__at", places).withColumn("__n", F.size(required))
    rows = rows.withColumn("coverage", F.when(F.col("__n") == 0, 0.0).otherwise(F.size("__at") / F.col("__n")))
    rows = rows.withColumn("proximity", F.when(F.size("__at") >= 2, 1.0 / (1.0 + (F.array_max("__at") - F.array_min("__at")) / 200.0)).otherwise(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("proximity"), F.desc("score"), "rank", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("__at", "__n")


def focus_queries(queries: DataFrame, profile: DataFrame, k: int = 6, min_idf: float = 1.2) -> DataFrame:
    """(query_id, term): a question's strongest terms by the corpus profile."""
    rows = tfidf.scored_terms(queries.select(F.col("query_id").alias("doc_id"), "text"), profile, min_idf)
    return tfidf.top_keywords(rows, k).select(F.col("doc_id").alias("query_id"), "term")


def fingerprint(text: Column, size: int = 520) -> Column:
    """Folded text with single spaces, cut to a prefix that stands for the content."""
    return F.left(X.squeeze(X.fold(text)), F.lit(size))


def drop_near_copies(results: DataFrame, k: int, content: str = "content", known: bool = False) -> DataFrame:
    """First of each content fingerprint per query by rank, ranked anew, at most ``k``; ``known``: ``content`` is the fingerprint."""
    rows = results.withColumn("__f", F.col(content) if known else fingerprint(X.text_or_empty(F.col(content))))
    same = Window.partitionBy("query_id", "__f").orderBy("rank", "chunk_id")
    rows = rows.withColumn("__n", F.when(F.col("__f") == "", 1).otherwise(F.row_number().over(same))).where("__n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__f", "__n")


def lexical_confidence(base: Column, hits: Column, n_terms: Column) -> Column:
    """coverage of 0.6 or more lifts the score towards 1, less coverage is a floor."""
    cover = hits / n_terms
    return F.when(n_terms == 0, base).when(cover >= 0.6, F.greatest(base, F.least(F.lit(1.0), 0.75 + cover * 0.25))).otherwise(F.greatest(base, cover))


def bm25_confidence(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def fuse(results: DataFrame, k: int, priority: Sequence[str] = L.CHANNEL_PRIORITY, k_per_query: bool = True) -> DataFrame:
    """Channels in priority order, each in its own order; the first row of a chunk wins, its best normalised score stays.

    Unknown channels come last, by name.  ``results`` has the columns of RESULT;
    the output too, with ``source`` hybrid where several channels were asked.
    """
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, c in enumerate(priority) for x in (c, i))), F.col("source")), F.lit(len(priority)))
    rows = results.withColumn("__p", place)
    chunk = Window.partitionBy("query_id", "chunk_id")
    rows = rows.withColumn("__best", F.max("score_normalized").over(chunk)).withColumn("__n", F.row_number().over(chunk.orderBy("__p", "source", "rank")))
    order = Window.partitionBy("query_id").orderBy("__p", "source", "rank", "chunk_id")
    rows = rows.where("__n = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("query_id", "chunk_id", "score", F.col("__best").alias("score_normalized"), "rank", "source")


def temporal_boost(score: Column, text: Column, words: Sequence[str] = ("when", "year", "date", "before", "after", "since", "until", "period")) -> Column:
    """0.15 more for a four-digit number or a word of time."""
    return score + F.when(text.rlike("\\b\\d{4}\\b") | F.lower(text).rlike("\\b(?:" + "|".join(words) + ")\\b"), 0.15).otherwise(0.0)


def rerank(results: DataFrame, k: int, model: Column | None = None) -> DataFrame:
    """By a pluggable score, else in the given order; normalised by the largest score kept, rounded to 3."""
    order = Window.partitionBy("query_id").orderBy(*([F.desc(model)] if model is not None else []), "rank", "chunk_id")
    rows = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return rows.withColumn("score_normalized", F.when(top > 0, F.round(F.col("score") / top, 3)).otherwise(0.0))


def fold_lists(results: DataFrame, k: int) -> DataFrame:
    """Sub-query lists folded in reverse: the last list leads, earlier ones follow; ``list_no`` numbers them."""
    chunk = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("list_no"), "rank")
    rows = results.withColumn("__n", F.row_number().over(chunk)).where("__n = 1").drop("__n")
    order = Window.partitionBy("query_id").orderBy(F.desc("list_no"), "rank", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keep_best_entries(candidates: DataFrame) -> DataFrame:
    """Per id the best score; on ties the earlier list."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "list_no")
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rank_entries(entries: DataFrame, k: int) -> DataFrame:
    """By focus hits, anchor hits, PageRank and score, all descending, then by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("focus_hits"), F.desc("anchor_hits"), F.desc("pagerank"), F.desc("score"), "id")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
