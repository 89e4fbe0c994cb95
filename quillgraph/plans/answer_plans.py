"""Queries on path context, statement alignment, learned labels and merged tables (GEN1, R6, A34, X18, F18, U8, ST7, SNK1, SNK3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import alignment, assertion_model, fanout, paths, policy
from ..sources import merged
from ..storage import application_dir, materialize
from .graph_plans import _REL, _SEEDS, phrases, relations, seeds
from .kit import Book, table

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql


@BOOK.query(f"""WITH RECURSIVE {_REL}, {_SEEDS}, nb AS MATERIALIZED (SELECT src AS a, dst AS b FROM rel UNION SELECT dst, src FROM rel), deg AS MATERIALIZED (SELECT a AS id, count(*) AS s FROM nb GROUP BY a),
t AS (SELECT id AS seed, id AS node, [id] AS path, CAST(0 AS BIGINT) AS score, 0 AS length FROM seeds UNION ALL SELECT seed, b, list_append(path, b), score + s, length + 1 FROM t JOIN nb ON node = a JOIN deg ON deg.id = b WHERE length < 3 AND NOT list_contains(path, b)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, length, path) AS rank FROM t WHERE length > 0) WHERE rank <= 8),
e AS (SELECT seed, rank, i, path[i] AS x, path[i + 1] AS y FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM r)),
l AS (SELECT seed, rank, string_agg(s.p_name || ' -[' || coalesce(f.relation_type, g.relation_type) || ']-> ' || d.p_name, chr(10) ORDER BY i) AS lines FROM e LEFT JOIN rel f ON f.src = x AND f.dst = y LEFT JOIN rel g ON g.src = y AND g.dst = x
 JOIN part s ON s.p_partkey = CASE WHEN f.src IS NOT NULL THEN x ELSE y END JOIN part d ON d.p_partkey = CASE WHEN f.src IS NOT NULL THEN y ELSE x END GROUP BY ALL)
SELECT seed, array_to_string(path, '>') AS path, score, CAST(length AS INTEGER) AS length, CAST(rank AS INTEGER) AS rank, lines FROM r JOIN l USING (seed, rank)""")
def gen1_best_paths(spark, sf):
    """The eight best paths of every seed, by the numbers of neighbours of their nodes."""
    rel = materialize(relations(spark, sf), "relations")
    ends = rel.select("src", "dst").unionByName(rel.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = paths.best_paths_of_seeds(seeds(spark, sf), rel, ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("score")))
    return paths.path_context(found, rel, phrases(spark, sf).select("id", "name")).withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@BOOK.query()
def a34_statement_alignment(spark, sf):
    """Every answer's statements against the sentences of the turn before it."""
    c = table(spark, sf, "conversations")
    said = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    rows = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(said, ["conv_id", "turn"])
    found = alignment.align(rows, F.col("answer"), F.col("evidence"), ["conv_id", "turn"], least=0.2)
    return found.select("conv_id", "turn", "n_statements", "n_evidence", "n_supported", *(F.round(c, 6).alias(c) for c in ("total", "precision", "recall", "f_beta")))


def silver_sentences(spark, sf):
    """(conv_id, turn, place, text, entity, label): every sentence of the conversations, labelled by the rules with plain cues."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"), "evidence")).alias("place", "text"))
    c = c.withColumn("entity", F.regexp_extract("text", "[a-z]{6,}", 0))
    return c.withColumn("label", policy.classify_assertion(F.col("text"), F.col("entity"), L.PLAIN_CUES)["label"])


@BOOK.query()
def u8_model_accuracy(spark, sf):
    """A classifier fitted on four fifths of the silver sentences: right labels in the last fifth, alone and behind the rules' guard."""
    rows = silver_sentences(spark, sf)
    held_out = F.pmod(F.xxhash64("conv_id", "turn", "place"), F.lit(5)) == 0
    model = assertion_model.fit(rows.where(~held_out))
    return assertion_model.accuracy(rows.where(held_out), model, cues=L.PLAIN_CUES)


@BOOK.query("SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY source")
def st7_staged_counts(spark, sf):
    """An ingest of three stages, which a signal could stop; none comes."""
    stages = [
        ("filled", lambda d: d.where(F.trim(F.coalesce("text", F.lit(""))) != "")),
        ("measured", lambda d: d.select("source", F.length("text").cast("long").alias("size"))),
        ("counted", lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_chars"))),
    ]
    return fanout.run_stages(table(spark, sf, "documents"), stages, fanout.StopSignal())


@BOOK.query("SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderkey % 2 = 1) > 0 THEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderkey % 2 = 1) ELSE arg_max(o_orderkey, (o_orderdate, o_orderkey)) END AS last_order FROM orders GROUP BY o_custkey")
def snk1_stored_merge(spark, sf):
    """Customers' last orders in a stored table: one merge of the even orders, then one of the odd."""
    path = f"{application_dir(spark)}/merged-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), "o_orderdate")
    for part in (0, 1):
        merged.merge_into(path, rows.where(F.pmod("last_order", F.lit(2)) == part), ["o_custkey"], ["o_orderdate", "last_order"], 16)
    return merged.read_merged(spark, path).select("o_custkey", "last_order")


@BOOK.query("SELECT doc_id, label FROM documents JOIN embeddings ON vec_id = doc_id")
def snk3_stored_passages(spark, sf):
    """Passages with a vector in a stored table; those without one are skipped, and a second merge of the same rows changes nothing."""
    path = f"{application_dir(spark)}/merged-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id", "left")
    for _ in range(2):
        merged.merge_into(path, rows, ["doc_id"], ["label"], 16, skip="coalesce(size(embedding), 0) <= 0")
    return merged.read_merged(spark, path).select("doc_id", "label")
