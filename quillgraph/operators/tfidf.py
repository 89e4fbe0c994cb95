"""Term statistics and keyword ranking."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..storage import materialize
from . import inverted_index
from .inverted_index import TextIndex


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term): one row per distinct term of a document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(X.terms(F.col(text_col))).alias("term"))


def document_count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row n: documents that are not blank, 1 at least."""
    return docs.agg(F.greatest(F.count_if(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != ""), F.lit(1)).alias("n"))


def idf_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A1, A2: (term, df, idf); partial counts merge map-side."""
    df = postings(docs, id_col, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    return df.join(F.broadcast(document_count(docs, text_col)), F.lit(True)).select("term", "df", idf.alias("idf"))


def indexed_terms(index: TextIndex, min_idf: float = 1.2) -> DataFrame:
    """:func:`scored_terms` of all documents of a stored index: a term's blocks meet its idf before they are unfolded."""
    idf = inverted_index.profile(index).where(F.col("idf") >= min_idf).select("term", "idf", (F.col("idf") * X.length_boost(F.col("term"))).alias("score"))
    return index.terms.select("term", "ids").join(idf, "term").select(F.explode("ids").alias("doc_id"), "term", "idf", "score")


def scored_terms(docs: DataFrame, profile: DataFrame | None = None, min_idf: float = 1.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, idf, score) with score = idf times the length boost, terms below ``min_idf`` left out.

    Without a ``profile`` the texts' own is used.
    """
    if profile is None:
        profile = materialize(idf_table(docs, id_col, text_col), "term-profile")
    pairs = postings(docs, id_col, text_col)
    rows = pairs.join(profile.select("term", "idf"), "term").where(F.col("idf") >= min_idf)
    return rows.select("doc_id", "term", "idf", (F.col("idf") * X.length_boost(F.col("term"))).alias("score"))


#: Frequent terms whose scores every task holds; a document's other terms, few as they are rare, are joined.
FREQUENT = 100_000


def strongest_terms(docs: DataFrame, k: int = 8, min_idf: float = 1.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`scored_terms` that can be among a document's best ``k``: its rare terms, and the best ``k`` of its frequent ones.

    Frequent terms are most of all pairs of a document and a term; they are ranked
    where the text is read, by :func:`top_keywords`' order, so only the rest and
    ``k`` rows a document are shuffled.
    """
    spark = docs.sparkSession
    profile = materialize(idf_table(docs, id_col, text_col).withColumn("score", F.col("idf") * X.length_boost(F.col("term"))), "term-profile")
    order = [-F.round("score", 9), -F.round("idf", 9), -F.length("term")]
    top = profile.orderBy(F.desc("df"), "term").limit(FREQUENT).select("term", "idf", "score", *(c.alias(f"k{i}") for i, c in enumerate(order))).collect()
    held = spark.sparkContext.broadcast({r.term: ((r.k0, r.k1, r.k2, r.term), r.idf, r.score) if r.idf >= min_idf else None for r in top})
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        known = held.value
        for f in frames:
            listed, rare = [], []
            for terms in f["terms"]:
                best = heapq.nsmallest(k, (x for t in terms if (x := known.get(t))))
                listed.append([{"term": x[0][3], "idf": x[1], "score": x[2]} for x in best])
                rare.append([t for t in terms if t not in known])
            yield pd.DataFrame({"doc_id": f["doc_id"], "best": listed, "rare": rare})

    rows = docs.select(F.col(id_col).alias("doc_id"), X.terms(F.col(text_col)).alias("terms"))
    rows = materialize(rows.mapInPandas(run, f"doc_id {id_type}, best array<struct<term:string,idf:double,score:double>>, rare array<string>"), "strongest")
    rare = rows.select("doc_id", F.explode("rare").alias("term")).join(profile.where(F.col("idf") >= min_idf).select("term", "idf", "score"), "term")
    return rows.select("doc_id", F.inline("best")).select("doc_id", "term", "idf", "score").unionByName(rare.select("doc_id", "term", "idf", "score"))


def top_keywords(scored: DataFrame, k: int = 8) -> DataFrame:
    """K2: the best ``k`` terms of each document by score, idf, length and term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("idf", 9)), F.desc(F.length("term")), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def signal_scores(docs: DataFrame, k: int = 8, min_idf: float = 1.2) -> DataFrame:
    """A5: sum of the best terms' scores over the root of the number of terms."""
    best = top_keywords(strongest_terms(docs, k, min_idf), k).groupBy("doc_id").agg(F.sum("score").alias("total"))
    sizes = docs.select("doc_id", F.greatest(F.size(X.terms(F.col("text"))), F.lit(1)).alias("n"))
    return sizes.join(best, "doc_id", "left").select("doc_id", F.coalesce(F.col("total") / F.sqrt("n"), F.lit(0.0)).alias("signal"))


def best_idf(docs: DataFrame) -> DataFrame:
    """Each document's strongest term."""
    best = scored_terms(docs, min_idf=0.0).groupBy("doc_id").agg(F.max("idf").alias("idf"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("idf", F.lit(0.0)).alias("best_idf"))


def frequent_words(docs: DataFrame, k: int = 10, stop_words: tuple[str, ...] = L.STOP_WORDS) -> DataFrame:
    """A4: the ``k`` most frequent words of three letters or more over all texts, stop words left out."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(X.text_or_empty(F.col("text"))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(*stop_words)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def source_profile(docs: DataFrame, key: str = "source", at_least: int = 3) -> DataFrame:
    """A3: terms by the number of sources that use them, only if every row names its source and there are enough of them."""
    guard = docs.agg(F.count_if(F.trim(F.coalesce(F.col(key), F.lit(""))) == "").alias("unnamed"), F.count_distinct(key).alias("keys"))
    pairs = docs.select(F.col(key).alias("key"), F.explode(X.terms(F.col("text"))).alias("term")).distinct()
    df = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(guard), (F.col("unnamed") == 0) & (F.col("keys") >= at_least))
    return df.select("term", "df", (F.ln((1.0 + F.col("keys")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
