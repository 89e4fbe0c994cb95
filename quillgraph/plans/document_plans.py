"""Queries on documents: chunkers, blocks, entities, readers and sinks (C1-C5, SRC*, SNK*, A13, A35, J4, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import entities as E
from ..sources import readers as S
from ..operators import control as C_
from .kit import Book, made_of, table, texts

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql


def docs(spark, sf):
    return texts(spark, sf).select("doc_id", "text")


@BOOK.query()
def c2_text_chunks(spark, sf):
    return C.apply_chunker(docs(spark, sf), C.chunk_text, "chunk_index int, chunk_id string, section string, content string")


@BOOK.query()
def c3_structured_chunks(spark, sf):
    return C.apply_chunker(docs(spark, sf), C.structured_chunks, "parent_index int, child_index int, kind string, section string, content string, context string")


@BOOK.query()
def c4_graph_chunks(spark, sf):
    return C.apply_chunker(docs(spark, sf), C.graph_chunks, "graph_chunk_type string, graph_entity_count int, content string")


@BOOK.query()
def c5_episodes(spark, sf):
    return C.apply_chunker(docs(spark, sf), lambda t: [{"episode": i, "content": e} for i, e in enumerate(C.episodes(t))], "episode int, content string")


@BOOK.query()
def src9_blocks(spark, sf):
    return C.apply_chunker(docs(spark, sf), lambda t: [{"order_index": i, "kind": b.kind, "content": b.text} for i, b in enumerate(C.blocks(t))], "order_index int, kind string, content string")


_MD = "(SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '## ' || source || chr(10) || coalesce(text, '') WHEN 2 THEN coalesce(text, '') || chr(10) || '### ' || lang || chr(10) || 'b' || chr(10) || 'c' ELSE 'intro' || chr(10) || '## One' || chr(10) || coalesce(text, '') || chr(10) || '# not cut' END AS md FROM documents)"


@BOOK.query("WITH l AS (SELECT id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM " + _MD + "), h AS (SELECT *, regexp_matches(line, '^#{2,3}\\s+.+$') AS head, sum(CASE WHEN regexp_matches(line, '^#{2,3}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS s FROM l) SELECT id, coalesce(max(CASE WHEN head THEN regexp_replace(line, '^#{2,3}\\s+', '') END), '') AS title, md5(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i)) AS content_md5 FROM h GROUP BY id, s HAVING count(*) FILTER (WHERE NOT head) > 0")
def c1_header_sections(spark, sf):
    got = C.apply_chunker(made_of(spark, sf, _MD), lambda t: [{"title": a, "content": b} for a, b in C.sections(t)], "title string, content string", "id", "md")
    return got.select(F.col("doc_id").alias("id"), "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@BOOK.query("WITH x AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, list_reduce(list_prepend(CAST(0 AS BIGINT), q), lambda a, v: CASE WHEN a + v <= 100 THEN a + v ELSE a END) AS used FROM x")
def w9_greedy_budget(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    return x.select("l_orderkey", C_.greedy_total(F.transform("s", lambda v: v["q"]), 100).alias("used"))


@BOOK.query()
def w9_prompt_selection(spark, sf):
    from .retrieval_plans import _top

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    results = _top(spark, sf, 20).withColumnRenamed("vec_id", "chunk_id").join(d, "chunk_id")
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    anchors = asked.select("query_id", F.array(F.lit("the"), F.lit("der"), F.lit("license")).alias("phrases"), F.array(F.lit("token")).alias("strong"))
    return C_.select_for_prompt(results, anchors, 5, 8000)


@BOOK.query()
def a13_entity_merge(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_type").alias("entity_type"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.array(F.col("p_partkey").cast("string")).alias("chunks"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("").alias("description"))
    return E.merge_by_type(rows).select("entity_type", "name", F.size("aliases").alias("n_aliases"), F.size("chunks").alias("n_chunks"), F.round("confidence", 6).alias("confidence"))


@BOOK.query()
def j4_fuzzy_names(spark, sf):
    """All customers, and all part names with one letter lost, doubled or replaced, against all part names."""
    p, size = table(spark, sf, "part"), F.length("p_name")
    at = (F.pmod("p_partkey", size) + 1).cast("int")
    head, tail = F.left("p_name", at - 1), F.substr("p_name", at + 1)
    here = F.substr("p_name", at, F.lit(1))
    typo = F.when(F.col("p_size") % 3 == 0, F.concat(head, tail)).when(F.col("p_size") % 3 == 1, F.concat(head, here, here, tail)).otherwise(F.concat(head, F.lit("x"), tail))
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(p.select(typo.alias("name")))
    return E.fuzzy_match(names, p.select(F.col("p_name").alias("name")))


@BOOK.query()
def a35_rouge_l(spark, sf):
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    pairs = q.join(c.where("role = 'assistant'"), ["conv_id", "turn"])
    return E.rouge_scores(pairs.select("conv_id", "turn", F.col("q").alias("reference"), F.col("text").alias("candidate"))).select("conv_id", "turn", F.round("rouge_l", 6).alias("rouge_l"))


@BOOK.query("SELECT page_id, length(html) AS n FROM pages")
def src2_decoded_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(S.decode(F.col("html").cast("binary"))).cast("long").alias("n"))


@BOOK.query("SELECT page, markdown, first AS src FROM (SELECT l_orderkey AS page, l_returnflag AS markdown, min(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS f, CASE WHEN min(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) = 0 THEN 'O' ELSE 'F' END AS first FROM lineitem GROUP BY 1, 2)")
def src5_merge_tables(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("markdown"), F.col("l_linestatus").alias("src"))
    return S.merge_tables(rows.where("src = 'O'"), rows.where("src <> 'O'"))


_TEX = "(SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name || ' $$x^' || p_size || '$$ b $$x^' || p_size || '$$' WHEN 1 THEN 'in (' || p_name || ') $$' || p_brand || '$$ and $$y$$' WHEN 2 THEN '$$' || chr(10) || p_name || chr(10) || '$$' ELSE p_name END AS md FROM part)"


@BOOK.query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(md, '(?s)\\$\\$(.+?)\\$\\$', 1), regexp_extract_all(md, '(?s)\\\\\\[(.+?)\\\\\\]', 1)), regexp_extract_all(md, '(?s)\\\\\\((.+?)\\\\\\)', 1)), lambda f: trim(f, chr(10) || ' ')))), ',') AS formulas FROM " + _TEX)
def src7_formulas(spark, sf):
    return made_of(spark, sf, _TEX).select("id", F.array_join(F.array_sort(S.extract_formulas(F.col("md"))), ",").alias("formulas"))


@BOOK.query("SELECT item_id, text || chr(10) || chr(10) || '## Extracted Formulas' || chr(10) || chr(10) || '$$x$$' AS md FROM benchmark")
def src8_augmented_markdown(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.augment_markdown(F.col("text"), X.no_strings(), F.array(F.lit("x"))).alias("md"))


@BOOK.query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 256")
def src17_passage_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(256)


@BOOK.query("SELECT p_partkey AS id, p_name AS name, coalesce(p_type, '') AS entity_type, coalesce(p_retailprice, 0) AS pagerank_score FROM part")
def src16_label_scan(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce("p_type", F.lit("")).alias("entity_type"), F.coalesce("p_retailprice", F.lit(0.0)).alias("pagerank_score"))


@BOOK.query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'new' ELSE p_brand END AS brand FROM part")
def snk2_upsert_nodes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_size")
    return S.upsert(p.drop("p_size").withColumn("v", F.lit(0)), p.where("p_size > 40").select("id", F.lit("new").alias("brand"), F.lit(1).alias("v")), ["id"], ["v"]).select("id", "brand")


@BOOK.query("SELECT vec_id, label FROM embeddings WHERE len(embedding) > 0")
def snk3_nodes_with_vectors(spark, sf):
    return table(spark, sf, "embeddings").where(F.size("embedding") > 0).select("vec_id", "label")


@BOOK.query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '-alias' ELSE p_brand END AS alias FROM part")
def snk4_alias_update(spark, sf):
    p = table(spark, sf, "part")
    new = p.where("p_size % 2 = 0").select("p_partkey", F.concat("p_brand", F.lit("-alias")).alias("a"))
    return p.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("a", "p_brand").alias("alias"))


@BOOK.query("SELECT count(*) AS n FROM documents")
def snk6_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND) WHERE nth <= 20 GROUP BY 1")
def snk8_trace_store(spark, sf):
    from ..operators import metrics as M

    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    live = e.join(F.broadcast(newest), F.expr("ts >= newest - interval 3600 seconds"))
    return M.last_n(live, "user_id", [F.desc("ts"), F.desc("event_id")], 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
