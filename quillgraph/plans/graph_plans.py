"""Queries on the property graph: parts are phrases, orders are passages, line items are mentions (J*, A8-A11, A31, W1, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import control as C_
from .kit import Book, table, texts
from .text_plans import _F1_ROWS, _WORDS_OF_INTEREST

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

#: Relations: the parts of neighbouring lines of an order.
_REL = """rel AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, arg_max(a.l_returnflag, (a.l_orderkey, a.l_linenumber, a.l_returnflag)) AS relation_type
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""
_SEEDS = "seeds AS (SELECT p_partkey AS id FROM part WHERE p_size = 50)"


def phrases(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_retailprice").alias("pagerank_score"), "p_size")


def mentions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("phrase_id"), F.col("l_orderkey").alias("passage_id")).distinct()


def relations(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    rows = li.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst")
    return rows.groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("relation_type"))


def seeds(spark, sf):
    return phrases(spark, sf).where("p_size = 50").select("id")


@BOOK.query("SELECT DISTINCT l_partkey AS phrase_id, l_orderkey AS passage_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def j1_link_mentions(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("phrase_id"), F.col("l_orderkey").alias("passage_id"))
    return G.link_mentions(pairs, phrases(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


@BOOK.query("SELECT a.n_nationkey AS src, b.n_nationkey AS dst, arg_max(r.t, r.seq) AS relation_type FROM (SELECT upper(n.n_name) AS s, m.n_name AS g, CASE WHEN n.n_regionkey = m.n_regionkey THEN 'same' ELSE 'other' END AS t, n.n_nationkey * 100 + m.n_nationkey AS seq FROM nation n JOIN nation m ON m.n_nationkey = (n.n_nationkey + 5) % 25 OR m.n_nationkey = n.n_nationkey) r JOIN nation a ON lower(trim(a.n_name)) = lower(trim(r.s)) JOIN nation b ON lower(trim(b.n_name)) = lower(trim(r.g)) WHERE a.n_nationkey <> b.n_nationkey GROUP BY 1, 2")
def j2_relate_by_name(spark, sf):
    n = table(spark, sf, "nation")
    m = n.select(F.col("n_nationkey").alias("mk"), F.col("n_name").alias("target"), F.col("n_regionkey").alias("mr"))
    rel = n.join(m, F.expr("mk = (n_nationkey + 5) % 25 or mk = n_nationkey"))
    rel = rel.select(F.upper("n_name").alias("source"), "target", F.when(F.col("n_regionkey") == F.col("mr"), "same").otherwise("other").alias("relation_type"), (F.col("n_nationkey") * 100 + F.col("mk")).alias("seq"))
    return G.relate_by_name(rel, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@BOOK.query("WITH k AS (SELECT p_type, lower(replace(p_name, ' ', '')) AS sig, max(p_partkey) AS known FROM part WHERE p_size > 25 GROUP BY ALL) SELECT p_partkey AS id, known AS known_id FROM part p JOIN k ON k.p_type = p.p_type AND k.sig = lower(replace(p.p_name, ' ', '')) WHERE p.p_size <= 25")
def j3_signature_match(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type"), F.array(X.alias_signature(F.col("p_name"))).alias("signatures"), F.col("p_partkey").alias("seq"), "p_size")
    return G.match_signatures(p.where("p_size <= 25"), p.where("p_size > 25"))


@BOOK.query("WITH t(term) AS (VALUES ('ring'), ('bolt')) SELECT id, n FROM (SELECT p_partkey AS id, count(*) AS n FROM part JOIN t ON contains(lower(p_name), term) GROUP BY 1) ORDER BY n DESC, id LIMIT 40")
def j6_rule_entry_points(spark, sf):
    return G.rule_entry_points(phrases(spark, sf), ("ring", "bolt"), 40)


@BOOK.query("WITH h AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS hits, count(*) FILTER (WHERE l_linestatus = 'O') AS background FROM lineitem GROUP BY 1), g AS (SELECT * FROM h WHERE hits >= 2 OR (hits >= 1 AND background >= 1)) SELECT l_partkey AS phrase_id, max(hits) AS hits FROM g JOIN lineitem ON l_orderkey = id GROUP BY 1 ORDER BY hits DESC, phrase_id LIMIT 30")
def j7_passage_seeds(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count_if(F.col("l_linestatus") == "O").alias("background"))
    return G.seed_passages(mentions(spark, sf), h, 30)


_TRAILS = f"""{_REL}, {_SEEDS}, step AS (SELECT src AS a, dst AS b, src, dst FROM rel UNION ALL SELECT dst, src, src, dst FROM rel),
t AS (SELECT id AS seed, id AS node, []::STRUCT(src BIGINT, dst BIGINT)[] AS path, 0 AS length FROM seeds
 UNION ALL SELECT seed, b, list_append(path, {{'src': step.src, 'dst': step.dst}}), length + 1 FROM t JOIN step ON node = a WHERE length < {{}} AND NOT list_contains(path, {{'src': step.src, 'dst': step.dst}}))"""


@BOOK.query("WITH RECURSIVE " + _TRAILS.replace("{}", "3").replace("{{", "{").replace("}}", "}") + " SELECT DISTINCT node AS connected, e.src AS src, relation_type, e.dst AS dst, length FROM (SELECT node, length, unnest(path) AS e FROM t WHERE length > 0) x JOIN rel ON rel.src = x.e.src AND rel.dst = x.e.dst")
def j8_trail_triples(spark, sf):
    return G.trail_triples(seeds(spark, sf), relations(spark, sf), 3)


@BOOK.query(f"WITH RECURSIVE {_REL}, {_SEEDS}, step AS (SELECT src AS a, dst AS b FROM rel UNION SELECT dst, src FROM rel), t AS (SELECT id AS seed, id AS node, 0 AS hops FROM seeds UNION SELECT seed, b, hops + 1 FROM t JOIN step ON node = a WHERE hops < 3) SELECT seed, node, min(hops) AS hops FROM t GROUP BY ALL HAVING min(hops) > 0")
def j9_reachability(spark, sf):
    return G.reachable(seeds(spark, sf), relations(spark, sf), 3)


_MEN = "m AS (SELECT DISTINCT l_partkey AS phrase_id, l_orderkey AS passage_id FROM lineitem)"


@BOOK.query(f"WITH {_SEEDS}, {_MEN} SELECT DISTINCT n.phrase_id AS neighbour, n.passage_id, p_retailprice AS pagerank_score FROM m s JOIN seeds ON s.phrase_id = seeds.id JOIN m n USING (passage_id) JOIN part ON p_partkey = n.phrase_id WHERE n.phrase_id NOT IN (SELECT id FROM seeds) ORDER BY pagerank_score DESC, neighbour, passage_id LIMIT 32")
def j10_co_mentioned(spark, sf):
    return G.co_mentioned(seeds(spark, sf), mentions(spark, sf), phrases(spark, sf))


@BOOK.query(f"WITH {_SEEDS}, {_MEN} SELECT passage_id, max(p_retailprice) AS phrase_pagerank FROM m JOIN seeds ON phrase_id = id JOIN part ON p_partkey = id GROUP BY 1 ORDER BY phrase_pagerank DESC, passage_id LIMIT 12")
def j12_collect_passages(spark, sf):
    return G.collect_passages(phrases(spark, sf).where("p_size = 50"), mentions(spark, sf))


@BOOK.query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？!?；;\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM l), p(a, b) AS (VALUES ('the', 'of'), ('and', 'was'), ('der', 'und'))
SELECT a AS source, 'CO_OCCURS_WITH' AS relation, b AS target, doc_id AS passage_id, md5(arg_min(s, i)) AS evidence_md5 FROM s, p WHERE contains(replace(lower(s), 'ß', 'ss'), a) AND contains(replace(lower(s), 'ß', 'ss'), b) AND (contains(lower(s), 'the') OR contains(lower(s), 'ge')) GROUP BY ALL""")
def j11_weak_triplets(spark, sf):
    pairs = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("the", "of"), ("and", "was"), ("der", "und"))))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    asked = d.select("passage_id", F.inline(pairs))
    found = C_.weak_triplets(d, asked, "CO_OCCURS_WITH", intents=("the", "ge"))
    return found.select("source", "relation", "target", "passage_id", F.md5(F.btrim("evidence", F.lit(" \n")).cast("binary")).alias("evidence_md5"))


_WORD = "len(regexp_extract_all(' ' || regexp_replace({0}, '([^0-9A-Za-z_])', '\\1\\1', 'g') || ' ', '(?i)(?:^|[^0-9A-Za-z_])' || {1} || '(?:[^0-9A-Za-z_]|$)')) > 0"


@BOOK.query(f"""WITH s AS (SELECT DISTINCT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？.!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents),
t AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '(license|token)') THEN 'mentions' WHEN regexp_matches(s, '(the|der)') THEN 'names' END AS relation_type FROM s), e(entity, entity_type) AS (VALUES ('of', 'Drug'), ('and', 'Disease'), ('und', 'Drug'), ('is', 'Test')),
m AS (SELECT doc_id, s, relation_type, entity, entity_type FROM t JOIN e ON {_WORD.format('s', 'entity')} WHERE relation_type IS NOT NULL)
SELECT source, relation_type, target, count(*) AS n FROM (SELECT DISTINCT a.doc_id, a.entity AS source, a.relation_type, b.entity AS target FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.s = b.s AND a.entity <> b.entity WHERE a.relation_type <> 'mentions' OR b.entity_type = 'Drug') GROUP BY ALL""")
def j16_sentence_pairs(spark, sf):
    e = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("entity_type")) for a, b in (("of", "Drug"), ("and", "Disease"), ("und", "Drug"), ("is", "Test"))))
    d = table(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("chunk"), F.explode(F.array_distinct(X.sentences(F.col("text")))).alias("sentence"))
    held = d.select(F.col("doc_id").alias("chunk"), F.inline(e))  # here every document has the same four entities
    found = C_.sentence_relations(s, held, (("mentions", "(license|token)"), ("names", "(the|der)")), ("mentions",))
    return found.groupBy("source", "relation_type", "target").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND contains(p.p_name, 'ring')) GROUP BY 1")
def j17_exists_join(spark, sf):
    gold = table(spark, sf, "part").where(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(gold, "l_partkey", "left_semi").join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey")).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'FURNITURE'")
def j18_session_lookup(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").join(table(spark, sf, "orders"), F.expr("o_custkey = c_custkey")).select("c_custkey", "o_orderkey")


@BOOK.query("WITH s AS (SELECT doc_id, i, CAST(i * 100 AS BIGINT) AS a, CAST((i + 1) * 100 AS BIGINT) AS b FROM documents, generate_series(0, CAST(floor(length(coalesce(text, '')) / 100.0) AS BIGINT)) AS g(i)), e AS (SELECT doc_id, strpos(coalesce(text, ''), 'the') - 1 AS x FROM documents) SELECT e.doc_id, i AS span, x - a AS offset_in_span FROM e JOIN s ON s.doc_id = e.doc_id AND x >= a AND x < b WHERE x >= 0")
def j19_offset_in_span(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.text_or_empty(F.col("text")).alias("t"))
    # spans of equal length hash: the range join becomes an equi join on (doc_id, span number)
    spans = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("t") / 100))).alias("span"))
    e = d.select("doc_id", (F.instr("t", "the") - 1).cast("long").alias("x")).where("x >= 0").withColumn("span", F.floor(F.col("x") / 100))
    return e.join(spans, ["doc_id", "span"]).select("doc_id", "span", (F.col("x") - F.col("span") * 100).alias("offset_in_span"))


def _rank_sql(damping: float, rounds: int, restart: str | None) -> str:
    v = "1.0 / (SELECT count(*) FROM part)" if restart is None else f"CASE WHEN {restart} THEN 1.0 / (SELECT count(*) FROM part WHERE {restart}) ELSE 0 END"
    ctes = [_REL, "o AS (SELECT src, CAST(count(*) AS DOUBLE) AS n FROM rel GROUP BY src)", f"b AS (SELECT p_partkey AS id, CAST({v} AS DOUBLE) AS v, p_partkey IN (SELECT src FROM o) AS has_out FROM part)", "r0 AS (SELECT id, CAST(1.0 / (SELECT count(*) FROM part) AS DOUBLE) AS score FROM b)"]
    for i in range(1, rounds + 1):
        ctes.append(f"r{i} AS (SELECT b.id, {damping} * (coalesce(f.s, 0) + (SELECT coalesce(sum(score), 0) FROM r{i - 1} JOIN b USING (id) WHERE NOT has_out) * v) + {1 - damping} * v AS score FROM b LEFT JOIN (SELECT dst AS id, sum(score / n) AS s FROM rel JOIN o USING (src) JOIN r{i - 1} ON r{i - 1}.id = rel.src GROUP BY dst) f USING (id))")
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return f"WITH {', '.join(ctes)} SELECT id, round(score * 1000, 6) AS score FROM r{rounds}"


@BOOK.query(_rank_sql(0.85, 8, None))
def a8_pagerank(spark, sf):
    nodes, edges = phrases(spark, sf).select("id"), relations(spark, sf).withColumn("weight", F.lit(1.0))
    return G.pagerank(nodes, edges, 0.85, 8).select("id", F.round(F.col("score") * 1000, 6).alias("score"))


@BOOK.query(_rank_sql(0.15, 5, "p_size = 50"))
def a9_personalised_pagerank(spark, sf):
    nodes, edges = phrases(spark, sf).select("id"), relations(spark, sf).withColumn("weight", F.lit(1.0))
    return G.pagerank(nodes, edges, 0.15, 5, restart=seeds(spark, sf)).select("id", F.round(F.col("score") * 1000, 6).alias("score"))


@BOOK.query("SELECT l_suppkey AS entity_id, round(max(p_retailprice / (SELECT max(p_retailprice) FROM part)), 6) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def a10_entity_rank_projection(spark, sf):
    ranks = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("rank"))
    rows = C_.project_rank(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), "l_partkey"), ranks, "entity_id", "l_partkey")
    return rows.select("entity_id", F.round("score", 6).alias("score"))


_SKEL = "x AS (SELECT p_partkey AS id, p_brand, 0.65 * p_retailprice / (SELECT max(p_retailprice) FROM part) + 0.35 * greatest(p_size / (SELECT CAST(max(p_size) AS DOUBLE) FROM part), CASE WHEN p_type = 'LARGE' THEN 1.0 ELSE 0.0 END) AS s FROM part)"


def _skeleton(spark, sf):
    p = table(spark, sf, "part")
    return G.skeleton_scores(p.select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_retailprice").alias("pagerank"), F.col("p_size").alias("n_entities"), (F.col("p_type") == "LARGE").alias("candidate")))


@BOOK.query(f"WITH {_SKEL} SELECT id, round(s, 6) AS skeleton_score FROM x")
def a11_skeleton_scores(spark, sf):
    return _skeleton(spark, sf).select("id", F.round("skeleton_score", 6).alias("skeleton_score"))


@BOOK.query(f"WITH {_SKEL}, r AS (SELECT id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY round(s, 9) DESC, id) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM x) SELECT id, r <= CASE WHEN n <= 10 THEN least(greatest(1, floor(n * 0.25)), greatest(2, floor((n + 1) / 2))) ELSE greatest(1, floor(n * 0.25)) END AS skeletal FROM r")
def w7_skeleton_selection(spark, sf):
    rows = _skeleton(spark, sf).withColumn("skeleton_score", F.round("skeleton_score", 9))
    return G.select_skeleton(rows, "p_brand").select("id", "skeletal")


@BOOK.query("SELECT entity_id, passage_id, CAST(rank AS INTEGER) AS rank FROM (SELECT l_suppkey AS entity_id, l_orderkey AS passage_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_quantity) DESC, l_orderkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def w1_top_passages(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("passage_id")).agg(F.max("l_quantity").alias("score"))
    return G.top_passages(s).select("entity_id", "passage_id", "rank")


@BOOK.query("SELECT dst_rank, src, dst FROM (SELECT l_suppkey AS src, l_partkey AS dst, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey DESC) AS INTEGER) AS dst_rank FROM lineitem GROUP BY 1, 2) WHERE dst_rank <= 5")
def w2_top_neighbours(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    return n.withColumn("dst_rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.desc("dst")))).where("dst_rank <= 5").select("dst_rank", "src", "dst")


@BOOK.query(f"WITH {_REL} SELECT 'Phrase' AS label, count(*) AS n FROM part UNION ALL SELECT 'Passage', count(*) FROM orders UNION ALL SELECT 'MENTIONED_IN', count(*) FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) UNION ALL SELECT 'RELATED_TO', count(*) FROM rel")
def a31_graph_counts(spark, sf):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
    return count(table(spark, sf, "part"), "Phrase").unionByName(count(table(spark, sf, "orders"), "Passage")).unionByName(count(mentions(spark, sf), "MENTIONED_IN")).unionByName(count(relations(spark, sf), "RELATED_TO"))


@BOOK.query(_F1_ROWS + " SELECT form AS name, doc_id, round(score, 6) AS score FROM scored WHERE score > 0")
def j5_mention_scan(spark, sf):
    e = spark.createDataFrame([(w,) for w in _WORDS_OF_INTEREST], "name string")
    found = G.mention_scan(texts(spark, sf).select(F.col("doc_id").alias("passage_id"), "text"), e)
    return found.select("name", F.col("passage_id").alias("doc_id"), F.round("score", 6).alias("score"))
