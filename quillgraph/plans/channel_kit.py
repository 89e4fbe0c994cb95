"""The question set, its nearest vectors and the graph provider's channel, shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import vectors as V
from ..storage import materialize
from .kit import table

_VEC = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_TOP = f"{_VEC}, s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.v, x.v), 9) AS score FROM e q, e x WHERE q.vec_id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


def _queries(spark, sf):
    """The stated query set of searches: every vector whose id is divisible by 20, against all rows."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _top(spark, sf, k):
    return V.block_top_k(_queries(spark, sf), table(spark, sf, "embeddings").select("vec_id", "embedding"), k)


#: Rows of a search up to which their ids are broadcast, so that texts that it didn't find are not shuffled.
MAX_BROADCAST_IDS = 2_000_000


def _found_texts(top, docs, id_col="doc_id"):
    """The rows of ``docs`` that a stored search has found."""
    ids = top.select(F.col("vec_id").alias(id_col)).distinct()
    return docs.join(F.broadcast(ids) if top.count() <= MAX_BROADCAST_IDS else ids, id_col, "left_semi")


_WS = "' ' || chr(9) || chr(10) || chr(13)"
#: A passage as indexing writes it: hints, a blank line, then the text; every third one has hints only in front of its lines, every fifth none.
_PASSAGE = "CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'Section: ' || source || chr(10) || 'Focus: x' || chr(10) || coalesce(text, '') ELSE 'Document summary: s' || chr(10) || chr(10) || coalesce(text, '') END"
_SOURCE = f"""pas AS (SELECT doc_id, trim({_PASSAGE}, {_WS}) AS t FROM documents),
lns AS (SELECT doc_id, t, trim(regexp_extract(t, '(?s)\\n[ \\t]*\\n(.*)$', 1), {_WS}) AS body, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pas),
ft AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: starts_with(x, 'Document summary:') OR starts_with(x, 'Section:') OR starts_with(x, 'Chunk position:') OR starts_with(x, 'Focus:')), false), 0) AS first FROM lns),
src AS (SELECT doc_id, CASE WHEN body <> '' THEN body WHEN first > 0 AND array_to_string(l[first:], chr(10)) <> '' THEN array_to_string(l[first:], chr(10)) ELSE t END AS s FROM ft)"""


def _passages(spark, sf):
    d = table(spark, sf, "documents")
    t = X.text_or_empty(F.col("text"))
    hints = F.when(F.col("doc_id") % 5 == 0, t).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Section: "), "source", F.lit("\nFocus: x\n"), t)).otherwise(F.concat(F.lit("Document summary: s\n\n"), t))
    return d.select("doc_id", hints.alias("passage"))


_START = "(starts_with(x, '-') OR starts_with(x, '*') OR starts_with(x, '•') OR starts_with(x, '|'))"

_QT = "qt AS (SELECT vec_id AS query_id, list_slice(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: lower(t))), 1, 0) AS none, list_slice(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: lower(t)), 1, 5) AS terms FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0)"


def _asked(spark, sf):
    """(query_id, terms): the first five tokens of each question's own document."""
    q = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("doc_id"))
    d = table(spark, sf, "documents").join(q, "doc_id", "left_semi")
    return d.select(F.col("doc_id").alias("query_id"), F.slice(X.latin_tokens(F.col("text")), 1, 5).alias("terms"))


_COVER = "CASE WHEN len(terms) = 0 THEN {0} WHEN hits / len(terms) >= 0.6 THEN greatest({0}, least(1.0, 0.75 + hits / len(terms) * 0.25)) ELSE greatest({0}, hits / len(terms)) END"
_TRIPLES = (("the", "of"), ("der", "und"), ("de", "la"))
_NAMES = ("and", "des", "ing")

#: The graph provider's rows as gz(query_id, chunk_id, rank, own, terms, hits, ...), after _TOP, _SOURCE and _QT.
_GRAPH = f"""gc AS (SELECT t.query_id, t.vec_id AS chunk_id, t.rank AS base_rank, s, replace(lower(s), 'ß', 'ss') AS low, terms FROM top t JOIN src ON src.doc_id = t.vec_id JOIN qt USING (query_id) WHERE t.rank <= 20),
gh AS (SELECT *, CAST(len(list_filter(terms, lambda t: contains(low, t))) AS DOUBLE) AS hits, CAST(contains(low, 'the') AND contains(low, 'of') AS INTEGER) + CAST(contains(low, 'der') AND contains(low, 'und') AS INTEGER) + CAST(contains(low, 'de') AND contains(low, 'la') AS INTEGER) AS paths,
 CAST(contains(low, 'and') AS INTEGER) + CAST(contains(low, 'des') AS INTEGER) + CAST(contains(low, 'ing') AS INTEGER) AS named, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, least(0.6, 1.0 / base_rank) AS base FROM gc),
gk AS (SELECT *, CASE WHEN hits > 0 OR paths > 0 THEN 1 ELSE 0 END AS k1, round(CASE WHEN len(terms) > 0 THEN hits / len(terms) ELSE 0 END, 9) AS k2,
 round(CASE WHEN len(l) = 0 THEN 0 ELSE greatest(0.0, (len(list_filter(l, lambda x: {_START} OR starts_with(x, '#'))) + len(list_filter(l, lambda x: NOT {_START} AND NOT contains(x, 'aliases:')))) / len(l) - (len(list_filter(l, lambda x: contains(x, '--') AND contains(x, '-->'))) + len(list_filter(l, lambda x: contains(x, 'aliases:')))) / len(l)) END, 9) AS k3,
 round(named + {_COVER.format('base')}, 9) AS k5 FROM gh),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k1 DESC, k2 DESC, k3 DESC, paths DESC, k5 DESC, base_rank, chunk_id) AS rank FROM gk), gz AS (SELECT *, least(0.6, 1.0 / rank) AS own FROM gr WHERE rank <= 8)"""


def graph_rows(spark, sf, top=None):
    """(query_id, chunk_id, score, score_normalized, rank): the passages that hold a question's terms, paths and names."""
    top = (materialize(_top(spark, sf, 20), "nearest") if top is None else top).where("rank <= 20")
    found = top.withColumnRenamed("vec_id", "chunk_id").withColumnRenamed("rank", "base_rank")
    passages = found.join(_found_texts(top, _passages(spark, sf)).select(F.col("doc_id").alias("chunk_id"), F.col("passage").alias("text")), "chunk_id").select("query_id", "chunk_id", "base_rank", "text")
    triplets = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in _TRIPLES))
    context = _asked(spark, sf).select("query_id", "terms", F.array(*map(F.lit, _NAMES)).alias("entities"), triplets.alias("triplets"))
    return E.rank_graph_passages(passages, context, 8)
