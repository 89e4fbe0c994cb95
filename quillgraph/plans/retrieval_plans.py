"""Queries on retrieval: vectors, BM25, fusion and ranking (R*, W*, J13, J14, A7, F11, F28, S*)."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inverted_index as II
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources.readers import keep_last
from ..storage import materialize
from .channel_kit import _COVER, _GRAPH, _QT, _SOURCE, _TOP, _VEC, _found_texts, _queries, _top, graph_rows
from .kit import Book, rounded, table, text_index

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

@BOOK.query(f"WITH {_TOP} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def r1_vector_top_k(spark, sf):
    return _top(spark, sf, 10).select("query_id", "vec_id", rounded(F.col("score")).alias("score"), "rank")


@BOOK.query(f"WITH {_VEC} SELECT q.vec_id AS query_id, round(avg(list_cosine_similarity(q.v, x.v)), 6) AS mean_cosine FROM e q JOIN e x USING (label) WHERE q.vec_id % 20 = 0 GROUP BY 1")
def f28_cosine_within_label(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return V.mean_cosine(q, e, "label").select("query_id", F.round("mean_cosine", 6).alias("mean_cosine"))


@BOOK.query()
def idx1_indexed_top_k(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.indexed_top_k(_queries(spark, sf), e, 10, *V.fit_index(e)).select("query_id", "vec_id", rounded(F.col("score")).alias("score"), "rank")


_FP = "left(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g')), 520)"
_R2 = f"""{_TOP}, c AS (SELECT t.query_id, t.vec_id AS chunk_id, t.score, t.rank, {_FP} AS f FROM top t JOIN documents d ON d.doc_id = t.vec_id WHERE t.rank <= 30),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY rank, chunk_id) AS n FROM c),
v AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM u WHERE n = 1)"""


def vector_channel(spark, sf, k=10, top=None):
    """R2: oversampled neighbours, near copies of passages dropped; ``top`` holds the neighbours if they are known."""
    top = (materialize(_top(spark, sf, 3 * k), "nearest") if top is None else top).where(F.col("rank") <= 3 * k)
    # the start of a passage that copies are known by goes to the join, not its text
    starts = _found_texts(top, table(spark, sf, "documents")).select(F.col("doc_id").alias("vec_id"), R.fingerprint(X.text_or_empty(F.col("text"))).alias("content"))
    return R.drop_near_copies(top.join(starts, "vec_id").withColumnRenamed("vec_id", "chunk_id"), k, known=True).drop("content")


@BOOK.query(f"WITH {_R2} SELECT query_id, chunk_id, round(score, 6) AS score, round(greatest(0, least(1, score)), 6) AS score_normalized, CAST(rank AS INTEGER) AS rank FROM v WHERE rank <= 10")
def r2_vector_provider(spark, sf):
    return vector_channel(spark, sf).select("query_id", "chunk_id", rounded(F.col("score")).alias("score"), rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("score_normalized"), "rank")


_TERMS = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: replace(lower(t), 'ß', 'ss')))"
_BM = f"""tok AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: replace(lower(t), 'ß', 'ss')) AS t FROM documents),
ln AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM df),
wt AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w FROM tf JOIN df USING (term), ln)"""


def _bench_terms(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.focus_queries(items, II.profile(text_index(spark, sf)))


_FOCUS = f"""q0 AS (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark),
q1 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(idf * (1.0 + least(length(term), 8) / 8.0), 9) DESC, round(idf, 9) DESC, length(term) DESC, term) AS r FROM q0 JOIN idf USING (term) WHERE idf >= 1.2),
q AS (SELECT query_id, term FROM q1 WHERE r <= 6)"""


@BOOK.query(f"WITH {_BM}, {_FOCUS} SELECT query_id, term FROM q")
def r4_focus_queries(spark, sf):
    return _bench_terms(spark, sf)


_BM25 = f"WITH {_BM}, {_FOCUS}, s AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM q JOIN wt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"


@BOOK.query(f"{_BM25} SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r3_bm25_search(spark, sf):
    return II.bm25(text_index(spark, sf), _bench_terms(spark, sf)).results.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@BOOK.query(f"WITH {_BM}, {_FOCUS} SELECT query_id, term, CAST(df AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS max_weight FROM q JOIN df USING (term) JOIN tf USING (term), ln GROUP BY ALL")
def idx1_term_blocks(spark, sf):
    """The posting blocks of the questions' terms, added up."""
    index = text_index(spark, sf)
    sums = index.terms.groupBy("term").agg(F.sum("n_docs").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("cf"), F.round(F.max("max_weight"), 6).alias("max_weight"))
    return _bench_terms(spark, sf).join(sums, "term").select("query_id", "term", "df", "cf", "max_weight")


_ANCHORED = f"""a0 AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
ph AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), lambda p: array_to_string(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: lower(w) NOT IN {R.ANCHOR_STOP_WORDS}), ' ')), lambda p: p <> '') AS every FROM a0),
pd AS (SELECT conv_id, turn, text, list_filter(list_transform(range(1, len(every) + 1), lambda i: CASE WHEN len(list_filter(every[1:i - 1], lambda e: lower(e) = lower(every[i]) OR list_contains(string_split(lower(e), ' '), lower(every[i])))) = 0 THEN every[i] END), lambda p: p IS NOT NULL) AS phrases FROM ph),
tk AS (SELECT conv_id, turn, phrases, list_filter(list_transform(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]+|[A-Za-z0-9_-]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN {R.ANCHOR_STOP_WORDS} AND NOT list_contains(string_split(lower(array_to_string(phrases, ' ')), ' '), t)) AS every FROM pd),
an AS (SELECT conv_id, turn, phrases, list_filter(list_transform(range(1, len(every) + 1), lambda i: CASE WHEN list_position(every, every[i]) = i THEN every[i] END), lambda t: t IS NOT NULL) AS tokens FROM tk)"""


@BOOK.query(f"WITH {_ANCHORED} SELECT conv_id, turn, array_to_string(CASE WHEN len(tokens) > 0 THEN tokens[1:4] ELSE phrases[1:2] END, '|') AS required, array_to_string(CASE WHEN len(tokens) > 0 THEN phrases[1:2] ELSE [] END, '|') AS optional FROM an")
def r4_anchors(spark, sf):
    a = R.anchors(X.text_or_empty(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", F.array_join("a.required", "|").alias("required"), F.array_join("a.optional", "|").alias("optional"))


def _clauses(spark, sf):
    """Of every benchmark passage: its third to fifth token as a phrase that must stand, and its focus terms."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(II.clause_tokens(F.col("text")), 3, 3).alias("tokens")).where(F.size("tokens") > 0)
    phrases = items.select("query_id", F.lit(" phrase").alias("clause"), F.lit(True).alias("must"), "tokens")
    return phrases.unionByName(_bench_terms(spark, sf).select("query_id", F.col("term").alias("clause"), F.lit(False).alias("must"), F.array("term").alias("tokens")))


_CLAUSES = f"""{_BM}, {_FOCUS}, ph AS (SELECT * FROM (SELECT item_id AS query_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: lower(t))[3:5] AS p FROM benchmark) WHERE len(p) > 0),
jt AS (SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS j FROM tok),
hits AS (SELECT query_id, doc_id, p, len(t) AS len, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) AS tf FROM ph JOIN jt ON contains(j, ' ' || array_to_string(p, ' ') || ' ')),
pi AS (SELECT query_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT query_id, unnest(p) AS term FROM ph) JOIN df USING (term), ln GROUP BY query_id),
pw AS (SELECT query_id, doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w FROM hits JOIN pi USING (query_id), ln),
s AS (SELECT pw.query_id, pw.doc_id, round(pw.w + coalesce(sum(wt.w), 0), 9) AS score, 1 + count(wt.w) AS n_clauses FROM pw LEFT JOIN q ON q.query_id = pw.query_id LEFT JOIN wt ON wt.term = q.term AND wt.doc_id = pw.doc_id GROUP BY pw.query_id, pw.doc_id, pw.w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@BOOK.query(f"WITH {_CLAUSES} SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, CAST(n_clauses AS BIGINT) AS n_clauses, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r4_clause_search(spark, sf):
    return II.clause_search(text_index(spark, sf), _clauses(spark, sf)).withColumn("score", F.round("score", 6))


@BOOK.query(f"""WITH {_CLAUSES}, c AS (SELECT r.query_id, r.doc_id AS chunk_id, r.score, r.rank, list_filter([strpos(lower(text), p[1]), strpos(lower(text), p[len(p)])], lambda x: x > 0) AS places FROM r JOIN documents USING (doc_id) JOIN ph USING (query_id) WHERE r.rank <= 10)
SELECT query_id, chunk_id, round(len(places) / 2.0, 6) AS coverage, round(CASE WHEN len(places) >= 2 THEN 1.0 / (1.0 + (list_max(places) - list_min(places)) / 200.0) ELSE 0 END, 6) AS proximity,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY len(places) DESC, CASE WHEN len(places) >= 2 THEN list_max(places) - list_min(places) ELSE 1e9 END, score DESC, rank, chunk_id) AS INTEGER) AS rank FROM c""")
def r3_anchor_order(spark, sf):
    """The clause search's results in R3's local order by the first and last token of their phrase."""
    clauses = _clauses(spark, sf)
    found = II.clause_search(text_index(spark, sf), clauses)
    ends = clauses.where("must").select("query_id", F.array(F.element_at("tokens", 1), F.element_at("tokens", -1)).alias("required"))
    rows = found.join(ends, "query_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return R.anchor_order(rows, F.col("text"), F.col("required")).select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"), F.round("proximity", 6).alias("proximity"), "rank")


_DOCQ = _FOCUS.replace("SELECT item_id AS query_id, unnest", "SELECT doc_id AS query_id, unnest").replace("FROM benchmark", "FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 20 = 0")
_LEX = "bs AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM q JOIN wt USING (term) GROUP BY ALL), br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"
def channel_set(spark, sf, k=10):
    """The three channels of the hybrid search by name, each a function of the questions (query_id) in the result schema."""
    docs = table(spark, sf, "documents")
    normal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    nearest = functools.cache(lambda: materialize(_top(spark, sf, max(20, 3 * k)), "nearest"))  # of two channels
    of = lambda name, rows: rows.select("query_id", "chunk_id", "score", "score_normalized", "rank", F.lit(name).alias("source"))

    def vector(asked):
        return of("vector", vector_channel(spark, sf, k, nearest()).join(asked, "query_id", "left_semi").withColumn("score_normalized", normal))

    def lexical(asked):
        index = text_index(spark, sf)
        texts = docs.withColumnRenamed("doc_id", "query_id").join(asked, "query_id", "left_semi").select("query_id", "text")
        return of("bm25", II.bm25(index, R.focus_queries(texts, II.profile(index)), k).results.withColumn("score_normalized", R.bm25_confidence(F.col("score"))))

    def graph(asked):
        return of("graph", graph_rows(spark, sf, nearest()).join(asked, "query_id", "left_semi"))

    return {"vector": vector, "bm25": lexical, "graph": graph}


def channels(spark, sf, k=10):
    """All rows of the three channels."""
    asked = _queries(spark, sf).select("query_id")
    return reduce(DataFrame.unionByName, (c(asked) for c in channel_set(spark, sf, k).values()))


_CHANNELS = f"""WITH {_R2}, {_BM}, {_DOCQ}, {_LEX}, {_SOURCE}, {_QT}, {_GRAPH}, ch AS (
SELECT query_id, chunk_id, score, greatest(0, least(1, score)) AS norm, rank, 'vector' AS source, 0 AS p FROM v WHERE rank <= 10
UNION ALL SELECT query_id, doc_id, score, score / (score + 1), rank, 'bm25', 1 FROM br WHERE rank <= 10
UNION ALL SELECT query_id, chunk_id, 1.0 / rank, {_COVER.format('own')}, rank, 'graph', 2 FROM gz)"""


@BOOK.query(f"{_CHANNELS}, k AS (SELECT *, max(norm) OVER (PARTITION BY query_id, chunk_id) AS best, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, rank) AS n FROM ch), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank, chunk_id) AS fr FROM k WHERE n = 1) SELECT query_id, chunk_id, round(best, 6) AS score_normalized, CAST(fr AS INTEGER) AS rank, source FROM o WHERE fr <= 15")
def w6_fusion(spark, sf):
    return R.fuse(channels(spark, sf), 15).select("query_id", "chunk_id", rounded(F.col("score_normalized")).alias("score_normalized"), "rank", "source")


@BOOK.query(f"{_CHANNELS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, rank) AS n FROM ch), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank, chunk_id) AS fr FROM k WHERE n = 1) SELECT query_id, chunk_id, CAST(fr AS INTEGER) AS rank, CASE WHEN max(score) OVER w > 0 THEN round(score / max(score) OVER w, 3) ELSE 0 END AS score_normalized, 'hybrid' AS source FROM o WHERE fr <= 5 WINDOW w AS (PARTITION BY query_id)")
def r10_hybrid_search(spark, sf):
    return R.rerank(R.fuse(channels(spark, sf), 15), 5).select("query_id", "chunk_id", "rank", "score_normalized", F.lit("hybrid").alias("source"))


@BOOK.query(f"{_CHANNELS} SELECT source, count(*) AS n_results, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM ch GROUP BY source")
def a16_provider_diagnostics(spark, sf):
    return channels(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_results"), rounded(F.max("score")).alias("max_score"), rounded(F.avg("score")).alias("avg_score"))


@BOOK.query(f"{_CHANNELS} SELECT query_id, round(coalesce(max(norm), max(CASE WHEN score BETWEEN 0 AND 1 THEN score END), 0), 6) AS signal FROM ch GROUP BY query_id")
def a40_top_evidence_signal(spark, sf):
    return channels(spark, sf).groupBy("query_id").agg(rounded(F.coalesce(F.max("score_normalized"), F.max(F.when(F.col("score").between(0, 1), F.col("score"))), F.lit(0.0))).alias("signal"))


@BOOK.query(f"{_CHANNELS}, lst AS (SELECT query_id, chunk_id, source, p, rank, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p DESC, rank) AS n FROM ch), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank, chunk_id) AS fr FROM lst WHERE n = 1) SELECT query_id, chunk_id, CAST(fr AS INTEGER) AS rank FROM o WHERE fr <= 12")
def r11_comprehensive_fold(spark, sf):
    number = F.create_map(*(F.lit(x) for i, c in enumerate(("vector", "bm25", "graph")) for x in (c, i)))
    return R.fold_lists(channels(spark, sf).withColumn("list_no", F.try_element_at(number, F.col("source"))), 12).select("query_id", "chunk_id", "rank")


@BOOK.query(f"{_CHANNELS} SELECT query_id, chunk_id, min(p) AS first_list FROM ch GROUP BY ALL")
def s1_ordered_union(spark, sf):
    number = F.create_map(*(F.lit(x) for i, c in enumerate(("vector", "bm25", "graph")) for x in (c, i)))
    return channels(spark, sf).groupBy("query_id", "chunk_id").agg(F.min(F.try_element_at(number, F.col("source"))).alias("first_list"))


@BOOK.query(f"{_CHANNELS} SELECT query_id, chunk_id, source FROM ch WHERE source = 'vector' UNION ALL SELECT query_id, chunk_id, source FROM ch x WHERE source = 'bm25' AND NOT EXISTS (SELECT 1 FROM ch y WHERE y.source = 'vector' AND y.query_id = x.query_id AND y.chunk_id = x.chunk_id)")
def s2_append_unique(spark, sf):
    ch = channels(spark, sf).select("query_id", "chunk_id", "source")
    base, extra = ch.where("source = 'vector'"), ch.where("source = 'bm25'")
    return base.unionByName(extra.join(base, ["query_id", "chunk_id"], "left_anti"))


@BOOK.query(f"WITH {_TOP} SELECT t.query_id, t.vec_id AS chunk_id, round(t.score + CASE WHEN regexp_matches(d.text, '\\b\\d{{4}}\\b') OR regexp_matches(lower(d.text), '\\b(?:when|year|date|before|after|since|until|period)\\b') THEN 0.15 ELSE 0 END, 6) AS score FROM top t JOIN documents d ON d.doc_id = t.vec_id WHERE t.rank <= 30")
def r8_temporal_boost(spark, sf):
    top = _top(spark, sf, 30).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return top.select("query_id", F.col("vec_id").alias("chunk_id"), rounded(R.temporal_boost(F.col("score"), F.col("text"))).alias("score"))


@BOOK.query(f"WITH {_VEC}, s AS (SELECT q.vec_id AS src, x.vec_id AS dst, round(list_cosine_similarity(q.v, x.v), 9) AS weight FROM e q, e x WHERE q.vec_id <> x.vec_id), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS r FROM s) WHERE r <= 10 AND weight > 0), c AS (SELECT src, CASE WHEN count(*) <= 1 THEN max(weight) ELSE least(greatest(quantile_cont(weight, 0.5), avg(weight) + stddev_pop(weight)), max(weight)) END AS cut FROM t GROUP BY src) SELECT src, dst, round(weight, 6) AS weight FROM t JOIN c USING (src) WHERE weight >= cut - 1e-9")
def j14_knn_graph(spark, sf):
    return V.knn_graph(table(spark, sf, "embeddings").select("vec_id", "embedding")).select("src", "dst", rounded(F.col("weight")).alias("weight"))


@BOOK.query(f"WITH {_TOP} SELECT query_id, round(CASE WHEN count(*) FILTER (WHERE score > 0) <= 1 THEN coalesce(max(CASE WHEN score > 0 THEN score END), 1) ELSE least(greatest(quantile_cont(CASE WHEN score > 0 THEN score END, 0.5), avg(CASE WHEN score > 0 THEN score END) + stddev_pop(CASE WHEN score > 0 THEN score END)), max(CASE WHEN score > 0 THEN score END)) END, 6) AS cut FROM top WHERE rank <= 10 GROUP BY query_id")
def a7_adaptive_cut(spark, sf):
    return V.adaptive_cut(_top(spark, sf, 10)).select("query_id", rounded(F.col("cut")).alias("cut"))


@BOOK.query("SELECT d.doc_id, len(e.embedding) AS dims, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def j13_attach_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dims"), "label")
    return table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left")


_WORDS = "('the', 'of', 'eriner')"


@BOOK.query(f"""WITH b AS (SELECT doc_id, CAST(len(list_filter(['the', 'of', 'eriner'], lambda t: contains(lower(text), t))) AS DOUBLE) AS hits, least(n_chars / 5000.0, 1.0) AS base FROM documents)
SELECT doc_id, round(CASE WHEN hits / 3 >= 0.6 THEN greatest(base, least(1.0, 0.75 + hits / 3 * 0.25)) ELSE greatest(base, hits / 3) END, 6) AS confidence FROM b""")
def f11_lexical_confidence(spark, sf):
    low = F.lower("text")
    hits = F.size(F.filter(F.array(F.lit("the"), F.lit("of"), F.lit("eriner")), lambda t: F.contains(low, t)))
    return table(spark, sf, "documents").select("doc_id", F.round(R.lexical_confidence(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), hits, F.lit(3)), 6).alias("confidence"))


@BOOK.query("WITH c AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_discount AS score, l_linenumber AS list_no FROM lineitem) SELECT query_id, id, score, list_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, list_no) AS n FROM c) WHERE n = 1")
def w4_keep_best_entry(spark, sf):
    return R.keep_best_entries(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("list_no")))


@BOOK.query("WITH e AS (SELECT l_orderkey AS query_id, l_linenumber AS id, CAST(contains(p_name, 'ring') AS INTEGER) AS focus_hits, CAST(contains(p_name, 'large') AS INTEGER) + CAST(contains(p_name, 'hot') AS INTEGER) AS anchor_hits, p_retailprice AS pagerank, l_discount AS score FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY focus_hits DESC, anchor_hits DESC, pagerank DESC, score DESC, id) AS rank FROM e) WHERE rank <= 3")
def w3_entry_rerank(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("p_partkey = l_partkey"))
    hit = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    return R.rank_entries(rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), hit("ring").alias("focus_hits"), (hit("large") + hit("hot")).alias("anchor_hits"), F.col("p_retailprice").alias("pagerank"), F.col("l_discount").alias("score")), 3).select("query_id", "id", "rank")


@BOOK.query(f"SELECT doc_id, n FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_FP} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def w5_content_fingerprints(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(R.fingerprint(X.text_or_empty(F.col("text"))).cast("binary")).alias("f"))
    return rows.groupBy("f").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(1).cast("long").alias("n"))


@BOOK.query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS at FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
def snk1_upsert_keep_last(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey")).select("c_custkey", "o_orderkey", "o_orderdate")
    return keep_last(rows, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("at"))
