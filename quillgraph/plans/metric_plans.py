"""Queries on metrics and sessions over events, labels, conversations, documents and the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import metrics as M
from ..operators import control as C_
from .kit import Book, table

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql


def events(spark, sf):
    return table(spark, sf, "events")


def _hits(words, col):
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({col}, w)))"


@BOOK.query(f"SELECT page_id, CASE WHEN m >= greatest(p, t) AND m > 0 THEN 'medical' WHEN p > t AND p > 0 THEN 'paper' WHEN t > 0 THEN 'technical' ELSE 'generic' END AS doc_type FROM (SELECT page_id, {_hits(L.PAPER_HINTS, 'h')} AS p, {_hits(L.TECHNICAL_HINTS, 'h')} AS t, {_hits(L.MEDICAL_HINTS, 'h')} AS m FROM (SELECT page_id, lower(html) AS h FROM pages))")
def a12_document_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.document_type(F.lower("html"), L.PAPER_HINTS, L.TECHNICAL_HINTS, L.MEDICAL_HINTS).alias("doc_type"))


@BOOK.query("SELECT p_name AS entity, p_brand AS alias, count(DISTINCT l_orderkey) AS n_chunks FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2")
def a14_promoted_aliases(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("p_partkey = l_partkey"))
    return C_.promoted_aliases(rows.select(F.col("p_name").alias("entity"), F.col("p_brand").alias("alias"), F.col("l_orderkey").alias("chunk")))


@BOOK.query("SELECT l_orderkey AS chunk, l_suppkey AS phrase, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS sources, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a15_candidate_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("phrase"), F.col("l_returnflag").alias("source"))
    return C_.merge_candidates(rows).withColumn("sources", F.array_join("sources", ","))


@BOOK.query("SELECT user_id, CAST(len(s) AS INTEGER) AS n, round(list_reduce(s, lambda a, x: (a + x) / 2), 6) AS running_mean FROM (SELECT user_id, list(value ORDER BY event_id) AS s FROM events GROUP BY 1)")
def a17_provider_summary(spark, sf):
    return M.running_pair_mean(events(spark, sf), "user_id", "value", "event_id").select("user_id", "n", F.round("running_mean", 6).alias("running_mean"))


@BOOK.query("WITH c AS (SELECT quality AS gold, 1 - toxic AS pred, count(*) AS n FROM labels GROUP BY ALL), g AS (SELECT gold AS label, sum(n) AS support, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS tp FROM c GROUP BY 1), p AS (SELECT pred AS label, sum(n) AS predicted FROM c GROUP BY 1), x AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM g FULL JOIN p USING (label)), y AS (SELECT label, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM x) SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1, CAST(support AS BIGINT) AS support FROM y")
def a18_classification_report(spark, sf):
    cells = M.confusion(table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic")), "quality", "pred")
    return M.per_label(cells).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@BOOK.query("SELECT quality AS gold, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def a18_confusion(spark, sf):
    return M.confusion(table(spark, sf, "labels"), "quality", "toxic")


@BOOK.query("SELECT event_type AS mode, kind, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(value), 4) AS mean_ms FROM (SELECT *, CAST(user_id % 4 AS INTEGER) AS kind FROM events) GROUP BY GROUPING SETS ((event_type), (kind), (event_type, kind))")
def a19_grouped_accuracy(spark, sf):
    rows = events(spark, sf).withColumn("kind", (F.col("user_id") % 4).cast("int"))
    return M.grouped_accuracy(rows, "event_type", "kind", F.col("value") > 50, F.col("value")).select("mode", "kind", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_ms", 4).alias("mean_ms"))


@BOOK.query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS judged, count(*) FILTER (WHERE event_type = 'purchase') AS correct, round(CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 0 ELSE count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type <> 'error') END, 6) AS accuracy FROM events")
def a20_qa_summary(spark, sf):
    judged, correct = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "purchase")
    return events(spark, sf).agg(F.count(F.lit(1)).alias("total"), judged.alias("judged"), correct.alias("correct"), F.round(M.ratio(correct, judged), 6).alias("accuracy"))


@BOOK.query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(sum(value), 2) AS total FROM events GROUP BY 1")
def a21_status_distribution(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.sum("value"), 2).alias("total"))


@BOOK.query("WITH x AS (SELECT d.doc_id, contains(lower(text), 'license') AS found, l.quality = 0 AS expected FROM documents d JOIN labels l USING (doc_id)) SELECT count(*) FILTER (WHERE found AND expected) AS tp, count(*) FILTER (WHERE found AND NOT expected) AS fp, count(*) FILTER (WHERE NOT found AND NOT expected) AS tn, count(*) FILTER (WHERE NOT found AND expected) AS fn FROM x")
def a22_entity_scoring(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return C_.detection_counts(x, F.contains(F.lower("text"), F.lit("license")), F.col("quality") == 0)


@BOOK.query("WITH r AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS graph_rate, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) AS base_rate FROM lineitem) SELECT round(graph_rate, 6) AS graph_rate, round(base_rate, 6) AS base_rate, round(base_rate - graph_rate, 6) AS absolute, round(CASE WHEN base_rate = 0 THEN 0 ELSE (base_rate - graph_rate) / base_rate END, 6) AS relative FROM r")
def a23_rate_reduction(spark, sf):
    r = table(spark, sf, "lineitem").agg(M.share(F.col("l_returnflag") == "R").alias("g"), M.share(F.col("l_linestatus") == "O").alias("b"))
    return r.select(F.round("g", 6).alias("graph_rate"), F.round("b", 6).alias("base_rate"), F.round(F.col("b") - F.col("g"), 6).alias("absolute"), F.round(M.ratio(F.col("b") - F.col("g"), F.col("b")), 6).alias("relative"))


@BOOK.query("SELECT conv_id, turn, CAST(h AS INTEGER) AS hits, h / 3.0 >= 0.5 AS passed FROM (SELECT conv_id, turn, len(list_filter(['the', 'und', 'la '], lambda k: contains(lower(coalesce(text, '')), k))) AS h FROM conversations)")
def a24_keyword_pass(spark, sf):
    hits = F.size(F.filter(F.array(F.lit("the"), F.lit("und"), F.lit("la ")), lambda k: F.contains(F.lower(X.text_or_empty(F.col("text"))), k)))
    return table(spark, sf, "conversations").select("conv_id", "turn", hits.alias("hits"), (hits / 3.0 >= 0.5).alias("passed"))


@BOOK.query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 3) AS mean_chars, max(n_chars) AS max_chars FROM documents GROUP BY lang, source")
def a25_chunk_statistics(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.max("n_chars").alias("max_chars"))


@BOOK.query("WITH x AS (SELECT quality AS a, 1 - toxic AS b, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS c FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS ab, round(avg(CASE WHEN a = c THEN 1.0 ELSE 0 END), 6) AS ac, round(avg(CASE WHEN b = c THEN 1.0 ELSE 0 END), 6) AS bc FROM x")
def a26_labeler_agreement(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("c"))
    agree = lambda p, q: F.round(M.share(F.col(p) == F.col(q)), 6).alias(p + q)
    return x.agg(agree("a", "b"), agree("a", "c"), agree("b", "c"))


@BOOK.query("SELECT source, count(*) AS n, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def a27_dataset_statistics(spark, sf):
    # the digest keeps the distinct count's shuffle narrow
    rows = table(spark, sf, "documents").select("source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("h")).alias("duplicates"), F.count_distinct("lang").alias("langs"))


@BOOK.query("SELECT event_type AS provider, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS hits, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 1.0 ELSE 0 END), 6) AS verified_rate FROM events GROUP BY 1")
def a28_trace_evaluation(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf).groupBy(F.col("event_type").alias("provider")).agg(F.sum(k).alias("hits"), F.round(M.share(k >= 50), 6).alias("verified_rate"))


@BOOK.query("WITH t AS (SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1) SELECT event_type, n, round(mean_value, 4) AS mean_value, round(n / (SELECT sum(n) FROM t), 6) AS share, CASE WHEN n / (SELECT sum(n) FROM t) > 0.3 THEN 'raise cache' WHEN n / (SELECT sum(n) FROM t) < 0.05 THEN 'drop tool' ELSE 'keep' END AS advice FROM t")
def a29_query_monitor(spark, sf):
    t = C_.monitor(events(spark, sf), "event_type", "value")
    return t.select("event_type", "n", F.round("mean_value", 4).alias("mean_value"), F.round("share", 6).alias("share"), "advice")


@BOOK.query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CASE WHEN event_type = 'error' THEN 500 ELSE 200 END >= 400) AS errors, round(avg(value), 4) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1")
def a30_request_metrics(spark, sf):
    return M.request_metrics(events(spark, sf), "event_type", F.when(F.col("event_type") == "error", 500).otherwise(200), F.col("value")).withColumn("mean_ms", F.round("mean_ms", 4))


@BOOK.query("SELECT event_type, round(avg(m), 6) AS score FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a32_mean_of_means(spark, sf):
    return M.mean_of_group_means(events(spark, sf), "event_type", "user_id", F.col("value")).select("event_type", F.round("score", 6).alias("score"))


@BOOK.query("SELECT source, round(CASE WHEN 4 * p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2 FROM (SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END) AS r FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def a33_f_beta(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(M.share(F.col("quality") == 1).alias("p"), M.share(F.col("toxic") == 0).alias("r"))
    return g.select("source", F.round(M.f_beta(F.col("p"), F.col("r"), 2.0), 6).alias("f2"))


@BOOK.query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') > 1 AS triggered, round(CASE WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 0 ELSE count(*) FILTER (WHERE role = 'assistant') / count(*) FILTER (WHERE role = 'user') END, 6) AS success FROM conversations GROUP BY 1")
def a38_self_correction(spark, sf):
    user, answer = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), (user > 1).alias("triggered"), F.round(M.ratio(answer, user), 6).alias("success"))


@BOOK.query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 1) AS good, (SELECT count(*) FROM benchmark) AS items, round((SELECT avg(n_chars) FROM documents) - (SELECT avg(length(text)) FROM benchmark), 4) AS length_gain")
def a39_roll_up(spark, sf):
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.avg("n_chars").alias("dl"))
    g = table(spark, sf, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"))
    b = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("items"), F.avg(F.length("text")).alias("bl"))
    return d.join(g, F.lit(True)).join(b, F.lit(True)).select("documents", "good", "items", F.round(F.col("dl") - F.col("bl"), 4).alias("length_gain"))


@BOOK.query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations")
def w8_positions(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))


@BOOK.query("WITH e AS (SELECT user_id, event_id, CAST(value < 40 AS INTEGER) AS e FROM events), g AS (SELECT *, sum(1 - e) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e), r AS (SELECT *, sum(e) OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM g), s AS (SELECT user_id, min(event_id) AS stop FROM r WHERE run = 3 GROUP BY 1) SELECT r.user_id, event_id FROM r LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop")
def w11_abort_after_empty(spark, sf):
    return M.abort_after_empty(events(spark, sf).select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") < 40).select("user_id", "event_id")


@BOOK.query("SELECT l_orderkey AS query_id, arg_max(l_linenumber, (CAST(l_returnflag = 'R' AS INTEGER), CAST(l_quantity AS BIGINT), -l_partkey, -l_linenumber)) AS attempt FROM lineitem GROUP BY 1")
def w12_best_attempt(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "R").alias("exact"), F.col("l_quantity").cast("long").alias("anchors"), F.col("l_partkey").alias("best_rank"), F.col("l_linenumber").alias("attempt"))
    return M.best_attempt(rows, "query_id")


@BOOK.query("SELECT user_id, event_id, CAST(nth AS INTEGER) AS nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 20")
def w13_last_per_session(spark, sf):
    return M.last_n(events(spark, sf), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "nth")


@BOOK.query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 50 ORDER BY event_id LIMIT 120")
def w14_label_quota(spark, sf):
    return M.quota(events(spark, sf).select("event_id", "event_type"), "event_type", ["event_id"], 50, 120)


@BOOK.query("SELECT doc_id, count(*) OVER (PARTITION BY trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS copies FROM documents")
def w16_copies(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(X.squeeze(F.lower(X.text_or_empty(F.col("text")))).cast("binary"), 256).alias("h"))
    # counts are aggregated first and joined back, so a large group of copies is not one window
    return rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")), "h").select("doc_id", "copies")


@BOOK.query("SELECT a.l_orderkey AS a, list_has_any(list_distinct(list(l_suppkey)), [1, 5, 9]) AS overlaps FROM lineitem a GROUP BY 1")
def s3_signature_overlap(spark, sf):
    want = F.array(*(F.lit(x).cast("long") for x in (1, 5, 9)))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(C_.overlaps(F.collect_set("l_suppkey"), want).alias("overlaps"))


@BOOK.query("WITH x AS (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'R')) AS cited, list_distinct(list(l_suppkey) FILTER (WHERE l_linestatus = 'O')) AS allowed FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(len(list_intersect(cited, allowed)), 0) AS known, len(coalesce(cited, [])) - coalesce(len(list_intersect(cited, allowed)), 0) AS unknown FROM x")
def s4_citation_sets(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("c"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("a"))
    x = x.select("l_orderkey", C_.citation_sets(F.col("c"), F.col("a")).alias("s"))
    return x.select("l_orderkey", F.size("s.known").cast("long").alias("known"), F.size("s.unknown").cast("long").alias("unknown"))


@BOOK.query("WITH x AS (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'R')) AS c, list_distinct(list(l_suppkey) FILTER (WHERE l_linestatus = 'O')) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(coalesce(a, []), coalesce(c, [])) AS subset FROM x")
def s5_subset_test(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("c"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("a"))
    return x.select("l_orderkey", C_.is_subset(F.col("c"), F.col("a")).alias("subset"))


@BOOK.query("SELECT p_brand, p_type, min(p_partkey) AS first_id FROM part GROUP BY ALL")
def s6_first_of_bag(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_partkey").alias("first_id"))
    return C_.first_of_bag(rows, ["p_brand", "p_type"], "first_id")


@BOOK.query("SELECT user_id, array_to_string(list_sort(list_filter(['click', 'view', 'search'], lambda s: list_contains(t, s))), ',') AS reused, array_to_string(list_sort(list_filter(['click', 'view', 'search'], lambda s: NOT list_contains(t, s))), ',') AS executed FROM (SELECT user_id, list_distinct(list(event_type)) AS t FROM events GROUP BY 1)")
def s7_channel_cache_plan(spark, sf):
    asked = F.array(F.lit("click"), F.lit("view"), F.lit("search"))
    g = events(spark, sf).groupBy("user_id").agg(C_.cache_plan(asked, F.collect_set("event_type")).alias("p"))
    return g.select("user_id", F.array_join("p.reused", ",").alias("reused"), F.array_join("p.executed", ",").alias("executed"))


@BOOK.query("SELECT event_id, n <= 5 AS within_calls, total <= 300 AS within_time FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events)")
def flt17_budgets(spark, sf):
    return C_.within_budgets(events(spark, sf), "user_id", "event_id", "value", 5, 300).select("event_id", "within_calls", "within_time")


@BOOK.query("SELECT event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS blocked FROM events")
def flt16_repeated_retry(spark, sf):
    return C_.repeated_retry(events(spark, sf), "user_id", "event_id", "event_type").select("event_id", "blocked")


@BOOK.query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-02 00:00:00' AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 50")
def flt19_temporal_filter(spark, sf):
    start, end = F.expr("timestamp_ntz'2024-01-01 06:00:00'"), F.expr("timestamp_ntz'2024-01-02 00:00:00'")
    return C_.temporal_filter(events(spark, sf), "ts", start, end, F.col("event_type") == "view", 50, "event_id").select("event_id", "event_type")


@BOOK.query("SELECT event_id, year(ts) AS y, contains(props, '2024') OR regexp_matches(props, '\\b\\d{4}\\b') AS dated FROM events")
def f34_dates(spark, sf):
    return events(spark, sf).select("event_id", F.year("ts").cast("long").alias("y"), (F.contains("props", F.lit("2024")) | F.col("props").rlike("\\b\\d{4}\\b")).alias("dated"))


@BOOK.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def f35_map_defaults(spark, sf):
    v = F.parse_json("props")
    return events(spark, sf).select("event_id", F.variant_get(v, "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("none")).alias("missing"))
