"""Queries on questions and the question loop (F4-F7, F9, F13, F26, F27, F29, X1-X6, PRJ4, PRJ7, R5-R7, R9, R12-R16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import plugins
from ..functions import text as X
from ..operators import agent as A
from ..operators import questions as Q
from ..operators import vectors as V
from ..storage import materialize
from .graph_plans import mentions, phrases, relations, seeds
from .kit import Book, made_of, table
from .retrieval_plans import _CHANNELS, _R2, channels

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

_Q = "(SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'eGFR小于30时' || p_name || '禁用吗' WHEN 1 THEN 'PCI术后 ' || p_brand || ' 持续多久' WHEN 2 THEN 'ACEI 和 ' || p_name || ' 的区别' WHEN 3 THEN p_name || ' ' || p_size || ' mg' WHEN 4 THEN p_name || ' >= ' || p_size || ' 或改用' ELSE '' END AS q FROM part)"


@BOOK.query("SELECT id, CASE WHEN regexp_matches(q, '禁忌|禁用|不能用|不宜') THEN '禁忌' WHEN regexp_matches(q, '首选|推荐|应该用|选择') THEN '推荐' WHEN regexp_matches(q, '替代|改用|换用|过敏') THEN '替代' WHEN regexp_matches(q, '疗程|持续|多久|多长') THEN '疗程' WHEN regexp_matches(q, '剂量|目标剂量|滴定|多少mg') THEN '剂量' WHEN regexp_matches(q, '副作用|不良反应|导致|引起') THEN '副作用' WHEN regexp_matches(q, '比较|优势|劣势|区别|差异') THEN '比较' ELSE '' END AS intent, CAST(len(regexp_extract_all(q, '(?:[<>≤≥]=?\\s*\\d+(?:\\.\\d+)?)|(?:\\d+(?:\\.\\d+)?\\s*(?:mg|ml|mmol|pg|g/L|%|次|分|期|级))')) AS INTEGER) AS n_constraints FROM " + _Q)
def f13_question_structure(spark, sf):
    s = Q.question_structure(F.col("q"))
    return made_of(spark, sf, _Q).select("id", s.alias("s")).select("id", "s.intent", F.size("s.constraints").alias("n_constraints"))


@BOOK.query()
def f9_query_signals(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return Q.question_anchors(rows).select("conv_id", "turn", "anchors", "strong")


@BOOK.query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '病|COPD') THEN 'Disease' ELSE 'Procedure' END AS entity_type FROM part")
def f6_entity_types(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Q.entity_type(F.col("p_name")).alias("entity_type"))


@BOOK.query("SELECT c_custkey, array_to_string(list_slice([c_name, c_mktsegment], 1, 2), ',') AS terms FROM customer")
def x6_expansion_terms(spark, sf):
    s = F.struct(F.array("c_name").alias("focus"), F.array(F.lower("c_name"), F.lit("x")).alias("constraints"), F.array("c_mktsegment", F.lower("c_mktsegment")).alias("background"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(Q.expansion_terms(s), ",").alias("terms"))


@BOOK.query("SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) > len(string_split(p_brand, ' ')) THEN p_name ELSE CASE WHEN lower(p_name) < lower(p_brand) THEN p_name ELSE p_brand END END AS first FROM part")
def r16_ranked_candidates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.element_at(Q.ranked_candidates(F.array("p_name", "p_brand")), 1).alias("first"))


@BOOK.query("SELECT p_partkey, p_name AS name, p_type AS entity_type, p_brand AS target FROM part")
def f27_extraction_lines(spark, sf):
    raw = F.concat(F.lit("noise\nENTITY: "), "p_name", F.lit(" | "), "p_type", F.lit("\nENTITY: \nRELATIONSHIP: "), "p_name", F.lit(" | has | "), "p_brand")
    rows = table(spark, sf, "part").select("p_partkey", Q.parse_extraction(raw).alias("x")).select("p_partkey", F.inline("x.entities"), F.col("x.relations").alias("r"))
    return rows.select("p_partkey", "name", "entity_type", F.element_at("r", 1)["target"].alias("target"))


@BOOK.query()
def f29_vector_cache_keys(spark, sf):
    return Q.vector_cache_keys(table(spark, sf, "embeddings"), "vec_id")


@BOOK.query()
def prj4_embedded_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return plugins.embed(rows).select("doc_id", "embedding")


@BOOK.query("WITH t(term) AS (VALUES ('the'), ('and'), ('der')), d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT doc_id, round(len(list_filter(['the', 'and', 'der'], lambda q: list_contains(w, q))) / 3.0, 6) AS relevance FROM d")
def r12_overlap_rerank(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.lit("the and der").alias("q"))
    return plugins.relevance(rows, "q", "text").select("doc_id", F.round("relevance", 6).alias("relevance"))


@BOOK.query("SELECT p_partkey AS id, p_retailprice AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 40")
def r14_entity_listing(spark, sf):
    top = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), "id").limit(40)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # 40 rows


@BOOK.query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id AS chunk_id, round(list_cosine_similarity(q.v, x.v), 9) AS score FROM e q, e x JOIN documents ON doc_id = x.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def r9_full_document_read(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    held = e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return V.block_top_k(q, held, 5).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")


@BOOK.query("""WITH rel AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
seeds AS (SELECT p_partkey AS id FROM part WHERE p_size = 50), near AS (SELECT id FROM seeds UNION SELECT dst FROM rel JOIN seeds ON src = id UNION SELECT src FROM rel JOIN seeds ON dst = id),
m AS (SELECT DISTINCT l_partkey AS phrase_id, l_orderkey AS passage_id FROM lineitem), b AS (SELECT passage_id, max(p_retailprice) AS score FROM m JOIN near ON phrase_id = id JOIN part ON p_partkey = id GROUP BY 1)
SELECT passage_id, score FROM b ORDER BY score DESC, passage_id LIMIT 12""")
def r6_graph_search(spark, sf):
    from ..operators import graph as G

    s = seeds(spark, sf)
    near = s.unionByName(G.reachable(s, relations(spark, sf), 1).select(F.col("node").alias("id"))).distinct()
    found = G.collect_passages(phrases(spark, sf).join(near, "id", "left_semi"), mentions(spark, sf))
    return found.select("passage_id", F.col("phrase_pagerank").alias("score"))


_ASKED = "(SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)"
_SAID = "'{0}=' || CAST(round({1}, 3) AS VARCHAR) || CASE WHEN {1} >= 0.9 THEN ' answer' ELSE ' retry' END"


@BOOK.query(f"""{_CHANNELS}, m AS (SELECT a.query_id, coalesce(max(CAST(norm AS DOUBLE)) FILTER (WHERE source = 'vector'), 0.0::DOUBLE) AS v, coalesce(max(CAST(norm AS DOUBLE)) FILTER (WHERE source = 'bm25'), 0.0::DOUBLE) AS b, coalesce(max(CAST(norm AS DOUBLE)) FILTER (WHERE source = 'graph'), 0.0::DOUBLE) AS g FROM {_ASKED} a LEFT JOIN ch USING (query_id) GROUP BY 1)
SELECT query_id, CASE WHEN v >= 0.9 THEN 0 WHEN b >= 0.9 THEN 1 ELSE 2 END AS retries, CASE WHEN v >= 0.9 OR b >= 0.9 OR g >= 0.9 THEN 'answer' ELSE 'retry' END AS status,
 {_SAID.format('vector', 'v')} || CASE WHEN v < 0.9 THEN '; ' || {_SAID.format('bm25', 'b')} ELSE '' END || CASE WHEN v < 0.9 AND b < 0.9 THEN '; ' || {_SAID.format('graph', 'g')} ELSE '' END AS explanation FROM m""")
def x1_question_loop(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    pool = materialize(channels(spark, sf), "channels")
    tool = lambda name: lambda q: pool.where(F.col("source") == name).join(q.select("query_id"), "query_id", "left_semi")
    loop = A.Loop({n: tool(n) for n in ("vector", "bm25", "graph")}, "vector", {"vector": "bm25", "bm25": "graph"}, good=0.9)
    _, trace = loop.run(asked)
    return A.explain_trace(trace).select("query_id", "retries", "status", "explanation")


@BOOK.query(f"{_CHANNELS} SELECT a.query_id, s.source FROM {_ASKED} a, (VALUES ('vector'), ('bm25'), ('graph'), ('web')) AS s(source) WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.query_id = a.query_id AND ch.source = s.source)")
def x3_silent_sources(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return A.silent_sources(channels(spark, sf), ["vector", "bm25", "graph", "web"], asked)


@BOOK.query(f"""WITH {_R2}, l AS (SELECT query_id, rank, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？.!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM v JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
ea AS (SELECT query_id, rank, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM l), fa AS (SELECT query_id, rank, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM ea WHERE regexp_matches(s, '\\d')),
k AS (SELECT query_id, replace(lower(s), 'ß', 'ss') AS k, min((rank, i)) AS first, arg_min(s, (rank, i)) AS s FROM fa GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, k) AS fact_no FROM k)
SELECT a.query_id, coalesce(string_agg(left(s, 500) || ' [fact:' || fact_no || ']', ' ' ORDER BY fact_no), '') AS answer, CASE WHEN count(fact_no) > 0 THEN 'passed' ELSE 'partial' END AS status FROM (SELECT DISTINCT query_id FROM v WHERE rank <= 10) a LEFT JOIN n ON n.query_id = a.query_id AND fact_no <= 3 GROUP BY 1""")
def x10_extractive_answers(spark, sf):
    d = table(spark, sf, "documents")
    results = channels(spark, sf).where("source = 'vector'")
    asked = results.select("query_id").distinct()
    return A.answer_questions(asked, results, d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))).select("query_id", "answer", F.col("citations.status").alias("status"))


@BOOK.query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{4,}'), lambda w: w NOT IN ('that', 'this', 'with', 'from')))), ',') AS terms FROM conversations WHERE role = 'user'")
def x2_anchor_terms(spark, sf):
    stop = F.array(*map(F.lit, ("that", "this", "with", "from")))
    w = F.array_distinct(F.regexp_extract_all(F.lower(X.text_or_empty(F.col("text"))), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.array_sort(F.array_except(w, stop)), ",").alias("terms"))
