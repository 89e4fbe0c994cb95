"""Queries on evidence: source text, windows, graph and vector results, packing (F12, W10, W15, R5, R7, R15, PRJ6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import vectors as V
from .channel_kit import _COVER, _GRAPH, _QT, _SOURCE, _START, _TOP, _WS, _asked, _passages, _top, graph_rows
from .kit import Book, rounded, table
from .retrieval_plans import _R2

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

_TERMS = ("the", "of", "license")
_TERM_SQL = "['the', 'of', 'license']"
@BOOK.query(f"""WITH {_SOURCE}, q AS (SELECT doc_id, s, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM src)
SELECT doc_id, md5(s) AS text_md5, len(list_filter({_TERM_SQL}, lambda t: contains(lower(s), t))) AS hits,
 round(CASE WHEN len(l) = 0 THEN 0 ELSE greatest(0.0, (len(list_filter(l, lambda x: {_START} OR starts_with(x, '#'))) + len(list_filter(l, lambda x: NOT {_START} AND NOT contains(x, 'aliases:')))) / len(l)
   - (len(list_filter(l, lambda x: contains(x, '--') AND contains(x, '-->'))) + len(list_filter(l, lambda x: contains(x, 'aliases:')))) / len(l)) END, 6) AS quality FROM q""")
def f12_source_evidence(spark, sf):
    s = E.source_text(F.col("passage"))
    rows = _passages(spark, sf).select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.md5(F.col("s").cast("binary")).alias("text_md5"), E.term_hits(F.col("s"), F.array(*map(F.lit, _TERMS))).cast("long").alias("hits"), F.round(E.source_quality(F.col("s")), 6).alias("quality"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_LIST = "(starts_with(ltrim({0}), '-') OR starts_with(ltrim({0}), '*') OR starts_with(ltrim({0}), '•'))"
_HITS = "contains(lower({0}), 'the') OR contains(lower({0}), 'license')"


@BOOK.query(f"""WITH s AS (SELECT doc_id, {_SENT} AS l FROM documents), a AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: {_HITS.format('x')}), true) AS pos FROM s),
w AS (SELECT *, l[pos] AS x, CASE WHEN pos > 1 THEN l[pos - 1] END AS p, coalesce({_HITS.format('l[pos + 1]')}, false) AS one, coalesce({_HITS.format('l[pos + 2]')}, false) AS two, coalesce({_HITS.format('l[pos + 3]')}, false) AS three,
 list_filter(range(greatest(pos - 7, 1), pos), lambda i: NOT {_LIST.format('l[i]')} AND regexp_matches(l[i], '[:：]$')) AS back FROM a WHERE pos > 0)
SELECT doc_id, md5(concat_ws(' ', CASE WHEN {_LIST.format('x')} THEN CASE WHEN len(back) > 0 THEN l[list_max(back)] END WHEN (regexp_matches(p, '[:：]$') OR length(p) <= 40) AND contains(p, '：') THEN p END,
 x, CASE WHEN one THEN l[pos + 1] END, CASE WHEN one AND two THEN l[pos + 2] END, CASE WHEN one AND two AND three THEN l[pos + 3] END)) AS window_md5 FROM w""")
def w10_evidence_windows(spark, sf):
    terms = F.array(F.lit("the"), F.lit("license"))
    rows = table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text"), "graph").alias("l"))
    at = F.array_min(F.filter(F.transform("l", lambda x, i: F.when(E.term_hits(x, terms) > 0, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("at", at).where("at is not null")
    return rows.select("doc_id", F.md5(E.sentence_window(F.col("l"), F.col("at"), terms).cast("binary")).alias("window_md5"))


@BOOK.query(f"""WITH {_R2}, {_QT}, x AS (SELECT v.query_id, v.chunk_id, v.score, v.rank, greatest(0, least(1, v.score)) AS base, terms, CAST(len(list_filter(terms, lambda t: contains(replace(lower(coalesce(d.text, '')), 'ß', 'ss'), t))) AS DOUBLE) AS hits
 FROM v JOIN documents d ON d.doc_id = v.chunk_id JOIN qt USING (query_id) WHERE v.rank <= 10)
SELECT query_id, chunk_id, round(score, 6) AS score, round({_COVER.format('base')}, 6) AS score_normalized, CAST(rank AS INTEGER) AS rank, 'vector' AS source FROM x""")
def prj6_vector_finalise(spark, sf):
    top = _top(spark, sf, 30).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id").withColumnRenamed("vec_id", "chunk_id")
    rows = E.finalise_vectors(top, _asked(spark, sf), 10)
    return rows.select("query_id", "chunk_id", rounded(F.col("score")).alias("score"), rounded(F.col("score_normalized")).alias("score_normalized"), "rank", "source")


@BOOK.query(f"WITH {_TOP}, {_SOURCE}, {_QT}, {_GRAPH} SELECT query_id, chunk_id, round(1.0 / rank, 6) AS score, round({_COVER.format('own')}, 6) AS score_normalized, CAST(rank AS INTEGER) AS rank FROM gz")
def r5_graph_provider(spark, sf):
    return graph_rows(spark, sf).select("query_id", "chunk_id", rounded(F.col("score")).alias("score"), rounded(F.col("score_normalized")).alias("score_normalized"), "rank")


@BOOK.query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.doc_id AS passage_id, round(list_cosine_similarity(q.v, x.v), 9) AS score, d.source FROM e q, e x JOIN documents d ON d.doc_id = x.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s) SELECT query_id, passage_id, source, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r7_passage_vector_search(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    passages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    found = V.passage_search(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), passages, e, 10)
    return found.select("query_id", "passage_id", "source", rounded(F.col("score")).alias("score"), "rank")


_GRAPH_TEXT = "'Graph paths:' || chr(10) || repeat('a -[r]-> b' || chr(10), CAST(doc_id % 9 AS INTEGER)) || chr(10) || chr(10) || 'Entities:' || chr(10) || repeat('name of an entity' || chr(10), CAST(doc_id % 13 AS INTEGER)) || chr(10) || chr(10) || 'Evidence:' || chr(10) || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')"


@BOOK.query(f"""WITH g AS (SELECT doc_id, trim({_GRAPH_TEXT}, {_WS}) AS t FROM documents), p AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '\\n\\s*\\n(Graph paths:|Entities:|Evidence:)', chr(1) || '\\1', 'g'), chr(1)), lambda s: trim(s, {_WS})), lambda s: s <> '') AS parts FROM g),
c AS (SELECT doc_id, t, list_transform(parts, lambda s: CASE WHEN starts_with(s, 'Graph paths:') THEN trim(array_to_string(string_split(s, chr(10))[1:5], chr(10)), {_WS}) WHEN starts_with(s, 'Entities:') THEN trim(array_to_string(string_split(s, chr(10))[1:7], chr(10)), {_WS})
  WHEN starts_with(s, 'Evidence:') THEN trim('Evidence:' || chr(10) || left(trim(substr(s, 10), {_WS}), 300), {_WS}) ELSE s END) AS parts FROM p),
u AS (SELECT doc_id, parts[i] AS s, i, sum(length(parts[i]) + CASE WHEN i > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM c)),
k AS (SELECT *, min(CASE WHEN i > 1 AND used > 600 THEN i WHEN used >= 600 THEN i + 1 END) OVER (PARTITION BY doc_id) AS stop FROM u),
o AS (SELECT doc_id, string_agg(trim(left(s, 600), {_WS}), chr(10) || chr(10) ORDER BY i) AS packed FROM k WHERE stop IS NULL OR i < stop GROUP BY doc_id)
SELECT doc_id, length(CASE WHEN length(t) <= 600 THEN t ELSE packed END) AS n_chars, md5(CASE WHEN length(t) <= 600 THEN t ELSE packed END) AS text_md5 FROM c JOIN o USING (doc_id)""")
def r15_compressed_graph_results(spark, sf):
    repeat = lambda s, n: F.expr(f"repeat('{s}', cast(doc_id % {n} as int))")
    text = F.concat(F.lit("Graph paths:\n"), repeat("a -[r]-> b\\n", 9), F.lit("\n\nEntities:\n"), repeat("name of an entity\\n", 13), F.lit("\n\nEvidence:\n"), F.regexp_replace(X.text_or_empty(F.col("text")), "\\s+", " "))
    rows = table(spark, sf, "documents").select("doc_id", E.compress_graph_result(text, 600).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@BOOK.query("""WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
p AS (SELECT l_orderkey, i, 0 AS grp, q AS used FROM s WHERE i = 1 UNION ALL SELECT s.l_orderkey, s.i, CASE WHEN used > 0 AND used + q > 60 THEN grp + 1 ELSE grp END, CASE WHEN used > 0 AND used + q > 60 THEN q ELSE used + q END FROM p JOIN s ON s.l_orderkey = p.l_orderkey AND s.i = p.i + 1)
SELECT l_orderkey, max(grp) + 1 AS n_groups, string_agg(CAST(grp AS VARCHAR), ',' ORDER BY i) AS groups FROM p GROUP BY l_orderkey""")
def w15_text_packing(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    groups = E.pack_sizes(F.transform("s", lambda v: v["q"]), 60)
    return x.select("l_orderkey", groups.alias("g")).select("l_orderkey", (F.array_max("g") + 1).alias("n_groups"), F.array_join(F.transform("g", lambda v: v.cast("string")), ",").alias("groups"))
