"""Queries on datasets and evaluation runs (F2, R13, SRC3, SRC15, ST2, X15, X18-X25, X27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entities as E
from ..operators import runs as U
from ..sources import readers as S
from .kit import Book, made_of, table
from .phrase_plans import _folder
from .retrieval_plans import _CHANNELS, channels

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql


@BOOK.query("SELECT conv_id, turn, m.mode, CASE m.mode WHEN 'short' THEN left(text, 5) WHEN 'turned' THEN reverse(text) ELSE text END AS answer FROM conversations, (VALUES ('plain'), ('short'), ('turned')) AS m(mode) WHERE role = 'user'")
def x19_run_modes(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    answer = lambda f: lambda q: q.select("conv_id", "turn", f(F.col("text")).alias("answer"))
    return U.run_modes(asked, {"plain": answer(lambda t: t), "short": answer(lambda t: F.left(t, F.lit(5))), "turned": answer(F.reverse)})


@BOOK.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 3 = l.l_linenumber % 3)")
def x23_unfinished_rows(spark, sf):
    work = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 3).alias("mode"))
    done = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3).alias("mode"))
    return U.unfinished(work, done, ["l_orderkey", "mode"]).select("l_orderkey", "l_linenumber", "l_partkey")


@BOOK.query("SELECT l_orderkey, string_agg(k || '=' || n, ',' ORDER BY k) AS kinds FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def x24_kind_counts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    got = U.kind_counts(rows, "l_orderkey", "kind")
    return got.select("l_orderkey", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kinds"))


_REVIEW = "(SELECT p_partkey AS id, 'about ' || p_name || ' here' AS text, p_name AS entity, CASE WHEN p_size % 3 = 0 THEN 6 END AS start, CASE WHEN p_size % 3 = 0 THEN 6 + length(p_name) END AS end_, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' negated ' ELSE 'affirmed' END AS gold_label, CASE WHEN p_size % 5 = 0 THEN 'affirmed' ELSE 'negated' END AS weak_label, p_brand AS source FROM part)"


@BOOK.query("SELECT p_partkey AS id, p_name AS entity, CASE p_size % 4 WHEN 1 THEN 'negated' ELSE 'affirmed' END AS label, 6 AS start, 6 + length(p_name) AS stop, 'gold_review:' || p_partkey || ':' || p_brand AS source, (CASE WHEN p_size % 5 = 0 THEN 'affirmed' ELSE 'negated' END) <> (CASE p_size % 4 WHEN 1 THEN 'negated' ELSE 'affirmed' END) AS weak_label_changed FROM part WHERE p_size % 4 <> 0")
def x22_compiled_gold(spark, sf):
    reviews = made_of(spark, sf, _REVIEW).withColumnRenamed("end_", "end")
    return U.compile_gold(reviews).select("id", "entity", "label", "start", F.col("end").alias("stop"), "source", "weak_label_changed")


@BOOK.query("""WITH r AS (SELECT p_partkey AS id, p_name || ' with ' || p_brand AS text, p_name, p_brand, p_size % 3 AS k FROM part), s AS (
SELECT id, text, p_name AS entity, 0 AS start, length(p_name) AS stop FROM r WHERE k = 0 UNION ALL SELECT id, text, p_brand, length(p_name) + 6, length(text) FROM r WHERE k = 0
UNION ALL SELECT id, text, p_name, 0, length(p_name) FROM r WHERE k = 1 UNION ALL SELECT id, text, p_brand, length(p_name) + 6, length(text) FROM r WHERE k = 1 UNION ALL SELECT id, text, text, 0, length(text) FROM r WHERE k = 2)
SELECT min(id) AS id, entity, start, stop FROM s GROUP BY text, entity, start, stop""")
def x21_record_spans(spark, sf):
    p, kind = table(spark, sf, "part"), F.col("p_size") % 3
    text = F.concat_ws(" with ", "p_name", "p_brand")
    at = F.length("p_name") + 6
    entity = lambda name, a, b: F.struct(name.alias("entity"), a.cast("int").alias("start_idx"), b.cast("int").alias("end_idx"))
    entities = F.array(entity(F.col("p_name"), F.lit(0), F.length("p_name") - 1), entity(F.lit(None).cast("string"), at, at + F.length("p_brand") - 1))
    fact = lambda a, b: F.struct(a.alias("subject"), b.alias("object"))
    spo = F.array(fact(F.col("p_name"), F.col("p_brand")), fact(F.lit(""), F.lit("nowhere")))
    rows = p.select(F.col("p_partkey").alias("id"), text.alias("text"), F.when(kind == 0, entities).alias("entities"), F.when(kind == 1, spo).alias("spo"))
    return U.spans_of_records(rows).select("id", "entity", "start", F.col("end").alias("stop"))


@BOOK.query("SELECT conv_id AS id, question, min(type) AS type FROM (SELECT conv_id, trim(coalesce(text, '')) AS question, CASE WHEN turn % 3 = 0 THEN 'unknown' WHEN turn % 3 = 1 THEN 'fact' ELSE 'list' END AS type FROM conversations) WHERE question <> '' GROUP BY 1, 2")
def x25_prepared_questions(spark, sf):
    kind = F.when(F.col("turn") % 3 == 0, F.lit(None).cast("string")).when(F.col("turn") % 3 == 1, " Fact_Retrieval ").otherwise("LIST")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("question"), kind.alias("question_type"), F.lit("").alias("answer"))
    return U.prepared_questions(rows, {"fact_retrieval": "fact"}).select("id", "question", "type")


@BOOK.query("WITH t AS (SELECT doc_id, '# ' || source || chr(10) || coalesce(text, '') || chr(10) || '  - ' || lang || ' ' AS md FROM documents), l AS (SELECT doc_id, list_transform(string_split(md, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' WHEN starts_with(ltrim(x), '#') THEN trim(regexp_replace(rtrim(x), '^#+', '')) WHEN starts_with(ltrim(x), '- ') THEN '• ' || trim(substr(ltrim(rtrim(x)), 3)) ELSE rtrim(x) END) AS l FROM t) SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS lines_md5 FROM l")
def x25_plain_lines(spark, sf):
    md = F.concat(F.lit("# "), "source", F.lit("\n"), X.text_or_empty(F.col("text")), F.lit("\n  - "), "lang", F.lit(" "))
    rows = table(spark, sf, "documents").select("doc_id", U.plain_lines(md).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n").cast("binary")).alias("lines_md5"))


_JUDGED = "(SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '{\"rating\": 2}' WHEN 1 THEN '{\"score\": 1.0}' WHEN 2 THEN '[0]' WHEN 3 THEN 'the rating is 2, I think' WHEN 4 THEN '{\"rating\": 5}' WHEN 5 THEN 'none' ELSE '' END AS one, CASE WHEN p_partkey % 2 = 0 THEN '{\"rating\": 1}' END AS two, '[{\"statement\": \"a\", \"attributed\": 1}, {\"statement\": \"b\", \"attributed\": ' || (p_size % 3) || '}, {\"attributed\": 1}]' AS items FROM part)"


@BOOK.query("""WITH r AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 2.0 END AS one, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS two, p_size % 3 AS k FROM part)
SELECT p_partkey, round(CASE WHEN one IS NULL AND two IS NULL THEN NULL ELSE (coalesce(one, 0) + coalesce(two, 0)) / (CASE WHEN one IS NULL THEN 0 ELSE 1 END + CASE WHEN two IS NULL THEN 0 ELSE 1 END) / 2.0 END, 6) AS relevance, CAST(CASE k WHEN 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS covered FROM r""")
def x18_judged_ratings(spark, sf):
    rows = made_of(spark, sf, _JUDGED)
    return rows.select("p_partkey", F.round(U.relevance_of(U.rating(F.col("one")), U.rating(F.col("two"))), 6).alias("relevance"), U.attributed_share(F.col("items")).alias("covered"))


@BOOK.query("SELECT event_type, '### ' || event_type || chr(10) || '  accuracy: ' || printf('%.2f', round(count(*) FILTER (WHERE event_id % 4 <> 0) * 100.0 / count(*), 2)) || '% (' || count(*) FILTER (WHERE event_id % 4 <> 0) || '/' || count(*) || ')' || chr(10) || '  mean retries: ' || printf('%.2f', round(avg(user_id % 3), 2)) AS report FROM events GROUP BY 1")
def x20_report(spark, sf):
    rows = table(spark, sf, "events").withColumn("retries", F.col("user_id") % 3)
    return U.report(rows, "event_type", F.col("event_id") % 4 != 0, "retries")


@BOOK.query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: ' || replace(coalesce(text, ''), chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def x15_sse_frames(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", U.sse_frame(F.col("role"), X.text_or_empty(F.col("text"))).alias("frame"))


@BOOK.query("SELECT conv_id, turn, CAST(i AS INTEGER) AS seq, substr(text, CAST(i * 16 + 1 AS BIGINT), 16) AS piece FROM conversations, generate_series(0, 100000) AS g(i) WHERE role = 'assistant' AND i * 16 < length(text)")
def st2_stream_pieces(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(U.stream_pieces(F.col("text"), 16)).alias("seq", "piece"))
    return rows


_TEMPLATES = [("negated", "患者否认{entity}。"), ("speculated", "不能排除{entity}"), ("affirmed", "{entity}已确诊"), ("broken", "no slot")]


@BOOK.query("WITH t(label, template) AS (VALUES ('negated', '患者否认{entity}。'), ('speculated', '不能排除{entity}'), ('affirmed', '{entity}已确诊')) SELECT label, replace(template, '{entity}', entity) AS text, entity, strpos(template, '{entity}') - 1 AS start, strpos(template, '{entity}') - 1 + length(entity) AS stop FROM t, (SELECT DISTINCT p_name || ' ' || p_brand AS entity FROM part)")
def x27_synthetic_samples(spark, sf):
    slots = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("entity"))
    return U.synthetic_samples(spark.createDataFrame(_TEMPLATES, "label string, template string"), slots).withColumnRenamed("end", "stop")


@BOOK.query(f"{_CHANNELS} SELECT query_id, chunk_id, source, CAST(rank AS INTEGER) AS rank FROM ch WHERE source IN ('vector', 'bm25')")
def r13_search_tools(spark, sf):
    found = channels(spark, sf).where("source in ('vector', 'bm25')")
    return found.select("query_id", "chunk_id", "source", "rank")


@BOOK.query()
def f2_fuzzy_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("left"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("right"))
    return E.fuzzy_ratios(p, "left", "right").select("p_partkey", F.round("ratio", 6).alias("ratio"))


@BOOK.query("SELECT CAST(doc_id % 32 AS INTEGER) AS file, count(*) AS n_lines, CAST(sum(length(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def src15_directory(spark, sf):
    """All documents as the lines of 32 text files below one folder, read again file by file."""
    path = _folder(spark, "directory")
    d = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(32)).cast("int").alias("file"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ").alias("value"))
    d.repartition(32, "file").write.partitionBy("file").text(path)
    read = S.read_documents(spark, f"{path}/file=*").select(F.regexp_extract("path", "file=(\\d+)", 1).cast("int").alias("file"), F.regexp_replace("text", "\n\\z", "").alias("text"))
    lines = F.split("text", "\n", -1)
    return read.groupBy("file").agg(F.sum(F.size(lines)).alias("n_lines"), F.sum(F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))).alias("n_chars"))


@BOOK.query("SELECT p_partkey, p_name AS markdown, 0 AS n_tables FROM part")
def src3_markdown_only(spark, sf):
    full = S.load_result(table(spark, sf, "part").select("p_partkey", F.col("p_name").cast("binary").alias("content")), "content")
    return full.select("p_partkey", "markdown", F.size("tables").alias("n_tables"))


_TABLES = "(SELECT p_partkey, 'text ' || p_name || chr(10) || '| name | brand |' || chr(10) || '|---|:--:|' || chr(10) || '| ' || p_name || ' | a, \"' || p_brand || '\" |' || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN '| x |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |' ELSE 'none' END AS md FROM part)"


@BOOK.query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, 'name,brand' || chr(10) || p_name || ',\"a, \"\"' || p_brand || '\"\"\"' || CASE WHEN p_size % 2 = 0 THEN ';x' || chr(10) || p_size ELSE '' END AS csv FROM part")
def src4_markdown_tables(spark, sf):
    rows = made_of(spark, sf, _TABLES).select("p_partkey", F.transform(S.markdown_tables(F.col("md")), S.table_csv).alias("t"))
    return rows.select("p_partkey", F.size("t").alias("n"), F.array_join("t", ";").alias("csv"))
