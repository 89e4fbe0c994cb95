"""Queries on control decisions (F16, F20-F25, A36, A37, GEN*, X*, ST1, ST6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import policy as P
from ..operators import control as C_
from .kit import Book, dealt, made_of, table

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

#: A sentence about each part, in ten forms that the rules tell apart; the same expression in both engines.
_SENT = """(SELECT p_partkey, p_name AS entity, CASE p_size % 10 WHEN 0 THEN '患者否认' || p_name WHEN 1 THEN '不能排除' || p_name WHEN 2 THEN '父亲有' || p_name WHEN 3 THEN '如果eGFR<30则禁用' || p_name WHEN 4 THEN '既往' || p_name || '病史'
 WHEN 5 THEN '诊断为' || p_name WHEN 6 THEN '无发热，但有' || p_name WHEN 7 THEN '未见异常' WHEN 8 THEN '无明显诱因；出现' || p_name ELSE '可能为' || p_brand || '，' || p_name END AS sentence FROM part)"""


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(words, col):
    return f"len(list_filter({_list(words)}, lambda w: contains({col}, w))) > 0"


_ASSERT = f"""WITH v AS (SELECT sentence, entity, strpos(sentence, entity) AS pos FROM {{src}}), p AS (SELECT *, string_split_regex(substr(sentence, greatest(pos - 24, 1), least(pos - 1, 24)), '{P.STOPS}')[-1] || chr(1) || string_split_regex(substr(sentence, pos + length(entity), 8), '{P.STOPS}')[1] AS near,
 regexp_matches(sentence, '(?:<|>|<=|>=|≤|≥)\\s*\\d+(?:\\.\\d+)?') OR regexp_matches(sentence, '(?:低于|高于|不低于|不超过|至少)\\s*\\d+') AS threshold FROM v)
SELECT {{keep}}, CASE WHEN pos = 0 THEN 'affirmed' WHEN {{fam}} THEN 'family_history' WHEN {{spec}} THEN 'speculated' WHEN {{neg}} THEN 'negated' WHEN {{cond}} THEN 'conditional' WHEN {{hist}} THEN 'historical' ELSE 'affirmed' END AS label"""


def _assert_sql(src, keep, cues):
    return _ASSERT.format(src=src, keep=keep, fam=f"({_any(cues['family_history'], 'sentence')} OR {_any(cues['family_history'], 'near')})", spec=_any(cues["speculated"], "near"), neg=_any(cues["negated"], "near"), cond=f"({_any(cues['conditional'], 'near')} OR threshold AND {_any(cues['conditional'], 'sentence')})", hist=_any(cues["historical"], "near"))


@BOOK.query(_assert_sql(_SENT, "p_partkey", L.ASSERTION_CUES).replace("SELECT sentence, entity, strpos", "SELECT p_partkey, sentence, entity, strpos") + " FROM p")
def f16_assertion_rules(spark, sf):
    return dealt(made_of(spark, sf, _SENT)).select("p_partkey", P.classify_assertion(F.col("sentence"), F.col("entity"))["label"].alias("label"))


_DOC_S = "(SELECT conv_id, turn, coalesce(text, '') AS sentence, regexp_extract(coalesce(text, ''), '[a-z]{6,}') AS entity FROM conversations)"


@BOOK.query("SELECT label, count(*) AS n FROM (" + _assert_sql(_DOC_S, "sentence", L.PLAIN_CUES) + " FROM p) GROUP BY 1")
def f16_assertion_counts(spark, sf):
    t = X.text_or_empty(F.col("text"))
    c = table(spark, sf, "conversations").select(t.alias("sentence"), F.regexp_extract(t, "[a-z]{6,}", 0).alias("entity"))
    return c.select(P.classify_assertion(F.col("sentence"), F.col("entity"), L.PLAIN_CUES)["label"].alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _checked(spark, sf):
    """A claim and one evidence text for each part, in six kinds."""
    p, kind = dealt(table(spark, sf, "part")), F.col("p_size") % 6
    none = X.no_strings()
    pick = lambda *values: F.element_at(F.array(*values), (kind + 1).cast("int"))
    claims = p.select(
        F.col("p_partkey").alias("claim_id"), F.array("p_brand").alias("entities"),
        pick(none, F.array(F.lit("eGFR<30")), F.array(F.lit("100 mg")), F.array(F.lit("5 mg")), none, none).alias("numbers"),
        pick(F.array(F.lit("禁用")), F.array(F.lit("禁用")), none, F.array(F.lit("推荐")), none, F.array(F.lit("改用"))).alias("actions"),
    )
    texts = pick(F.concat("p_brand", F.lit(" 孕妇不能使用")), F.concat("p_brand", F.lit(": eGFR < 30 禁用")), F.concat("p_brand", F.lit(" 每次 75 mg")), F.concat("p_brand", F.lit("：5 mg 每日")), F.lit("nothing here"), F.concat(F.lit("ACEI 干咳时 "), "p_brand", F.lit(" 改用")))
    evidence = p.select(F.col("p_partkey").alias("claim_id"), F.lit(1).alias("pos"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("chunk_id"), texts.alias("content"))
    return P.check_claims(claims, evidence)


@BOOK.query("SELECT p_partkey AS claim_id, CASE p_size % 6 WHEN 2 THEN 'incorrect' WHEN 3 THEN 'possible_correct' WHEN 4 THEN 'possible_correct' ELSE 'correct' END AS level, CASE p_size % 6 WHEN 2 THEN 'hard_fail' WHEN 3 THEN 'soft_fail' WHEN 4 THEN 'hard_fail' ELSE 'none' END AS failure, CASE p_size % 6 WHEN 4 THEN '' ELSE 'e' || p_partkey END AS chunk_id FROM part")
def f20_claim_checks(spark, sf):
    return _checked(spark, sf)


@BOOK.query("WITH x AS (SELECT l_orderkey AS query_id, CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'N' THEN 'possible_correct' ELSE 'incorrect' END AS level FROM lineitem) SELECT query_id, count(*) AS claims_total, count(*) FILTER (WHERE level = 'correct') AS claims_supported, count(*) FILTER (WHERE level = 'possible_correct') AS claims_possible, count(*) FILTER (WHERE level = 'incorrect') AS claims_incorrect, CASE WHEN count(*) FILTER (WHERE level = 'incorrect') > 0 THEN 'retry_required' WHEN count(*) FILTER (WHERE level = 'possible_correct') > 0 THEN 'partial' ELSE 'passed' END AS status FROM x GROUP BY 1")
def a37_verification_summary(spark, sf):
    level = F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "N", "possible_correct").otherwise("incorrect")
    return P.verification_summary(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), level.alias("level")), "query_id")


_ANS = "(SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name || ' [fact:f1] b [fact:f9]' WHEN 1 THEN '[fact:f1][fact:f2] ' || p_name WHEN 2 THEN p_brand || ' [fact:' || p_brand || ']' ELSE p_name END AS answer FROM part)"


@BOOK.query("WITH c AS (SELECT id, list_distinct(regexp_extract_all(answer, '\\[fact:([^\\]]+)\\]', 1)) AS c FROM " + _ANS + ") SELECT id, CAST(len(c) AS INTEGER) AS cited, CAST(len(list_intersect(c, ['f1', 'f2'])) AS INTEGER) AS known, CASE WHEN len(c) > 0 AND len(list_intersect(c, ['f1', 'f2'])) = len(c) THEN 'passed' ELSE 'partial' END AS status FROM c")
def a36_citation_coverage(spark, sf):
    c = P.citation_coverage(F.col("answer"), F.array(F.lit("f1"), F.lit("f2")))
    return made_of(spark, sf, _ANS).select("id", c.alias("c")).select("id", "c.cited", "c.known", "c.status")


@BOOK.query("SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '\\d') THEN 'missing_numeric_fact' WHEN regexp_matches(coalesce(text, ''), '[A-Z][a-z]+') THEN 'missing_entity' ELSE 'missing_relation' END AS gap, CASE WHEN regexp_matches(coalesce(text, ''), '\\d') THEN 'bm25_search' WHEN regexp_matches(coalesce(text, ''), '[A-Z][a-z]+') THEN 'hybrid_search' ELSE 'cypher_traverse' END AS tool FROM conversations")
def f22_gap_plan(spark, sf):
    t = X.text_or_empty(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", P.gap_type(F.lit(0), t, F.regexp_count(t, F.lit("[A-Z][a-z]+"))).alias("gap"))
    return rows.withColumn("tool", P.correction_tool(F.col("gap")))


@BOOK.query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'stop' WHEN event_type = 'view' THEN 'answer' WHEN value < 20 THEN 'rerank' WHEN value > 100 THEN 'stop' WHEN user_id % 2 = 0 THEN 'answer' ELSE 'retry' END AS verdict FROM events")
def f23_reflection_verdict(spark, sf):
    e = table(spark, sf, "events")
    step = {
        "verdict": F.when(F.col("event_type") == "error", " STOP ").when(F.col("event_type") == "view", "answer").otherwise("unsure"),
        "retry_scope": F.when(F.col("value") < 20, "rerank_only").when(F.col("value") > 100, "stop").otherwise("provider_refresh"),
        "should_retry": F.lit(True),
        "failure_type": F.when(F.col("user_id") % 2 == 0, "acceptable").otherwise("weak"),
        "recommended_action": F.lit(""),
        "should_rerank_again": F.lit(False),
    }
    return e.select("event_id", P.verdict(step).alias("verdict"))


@BOOK.query("WITH t AS (SELECT user_id, list_distinct(list(event_type)) AS seen FROM events GROUP BY 1) SELECT user_id, list_filter(['hybrid_search', 'comprehensive_search'], lambda x: NOT (x = 'hybrid_search' AND list_contains(seen, 'error')))[1] AS tool FROM t")
def f24_next_tool(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    tried = F.when(F.array_contains("seen", "error"), F.array(F.lit("hybrid_search"))).otherwise(X.no_strings())
    return g.select("user_id", P.next_tool(F.lit("conflicting_evidence"), F.lit("none"), tried).alias("tool"))


@BOOK.query("SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '\\d') THEN 'vector_search,bm25_search' ELSE 'vector_search,cypher_traverse' END AS plan FROM conversations")
def f25_tool_plan(spark, sf):
    number = X.text_or_empty(F.col("text")).rlike("\\d")
    needs = F.when(number, F.array(F.lit("semantic_passage"), F.lit("exact_numeric"))).otherwise(F.array(F.lit("graph_relation")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(P.tool_plan(F.lit("vector_search"), needs, number), ",").alias("plan"))


@BOOK.query("SELECT l_orderkey AS query_id, l_linenumber AS rank, CAST(CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i / 2 ELSE n - (i + 1) / 2 END AS INTEGER) AS place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def gen2_prompt_order(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("score"))
    return P.prompt_order(rows).select("query_id", "rank", "place")


@BOOK.query("WITH s AS (SELECT source, doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？.!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents), e AS (SELECT source, doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s), f AS (SELECT source, doc_id, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM e WHERE regexp_matches(s, '\\d')), k AS (SELECT source, replace(lower(s), 'ß', 'ss') AS k, min((doc_id, i)) AS first, arg_min(s, (doc_id, i)) AS s FROM f GROUP BY 1, 2) SELECT source AS query_id, CAST(n AS INTEGER) AS fact_no, left(s, 500) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first, k) AS n FROM k) WHERE n <= 20")
def f21_evidence_contract(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return P.evidence_facts(d).select("query_id", "fact_no", "text")


@BOOK.query("SELECT c.conv_id, c.turn, string_agg(left(p.text, 180), ' | ' ORDER BY p.turn) AS context FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 3 WHERE c.role = 'user' GROUP BY 1, 2")
def gen4_follow_up_context(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-3, -1)
    past = F.array_sort(F.collect_list(F.struct("turn", F.left("text", F.lit(180)).alias("t"))).over(w))
    rows = c.withColumn("past", past).where((F.col("role") == "user") & (F.size("past") > 0))
    return rows.select("conv_id", "turn", F.array_join(F.transform("past", lambda x: x["t"]), " | ").alias("context"))


@BOOK.query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'band') THEN p_name || CASE WHEN contains(p_name, 'ring') THEN '' ELSE ' ring' END || CASE WHEN contains(p_name, 'band') THEN '' ELSE ' band' END ELSE p_name END AS expanded FROM part")
def gen5_alias_expansion(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C_.expand_aliases(F.col("p_name"), ("ring", "band")).alias("expanded"))


@BOOK.query("SELECT l_orderkey, array_to_string(list_slice(list(l_returnflag || '-' || l_suppkey ORDER BY l_linenumber, l_returnflag || '-' || l_suppkey), 1, 8), '; ') AS prefix FROM lineitem GROUP BY 1")
def gen1_context_prefix(spark, sf):
    rows = C_.ordered_join(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.concat_ws("-", "l_returnflag", "l_suppkey"), "; ", 8)
    return rows.withColumnRenamed("text", "prefix")


@BOOK.query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def gen3_messages(spark, sf):
    rows = C_.ordered_join(table(spark, sf, "conversations"), "conv_id", "turn", F.concat_ws(": ", "role", "text"), "\n")
    return rows.withColumnRenamed("text", "messages")


@BOOK.query("SELECT event_id, event_type AS mode, CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 3 END AS priority FROM events")
def x5_channel_priority(spark, sf):
    place = C_.channel_priority(F.col("event_type"), ("view", "click", "purchase"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("mode"), place.alias("priority"))


@BOOK.query("SELECT conv_id, turn, 'simple' AS query_type, 0.5 AS confidence, 'vector_search' AS suggested_tool FROM conversations WHERE role = 'user'")
def x8_router(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return C_.route(asked).select("conv_id", "turn", "query_type", "confidence", "suggested_tool")


@BOOK.query("SELECT conv_id, turn, CAST(i AS INTEGER) AS seq, substr(text, CAST(i AS BIGINT), 1) AS token FROM conversations, generate_series(1, length(text)) AS g(i) WHERE role = 'assistant' AND length(text) > 0")
def st1_token_events(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant' and length(text) > 0")
    seq = F.explode(F.sequence(F.lit(1), F.length("text")))
    return c.select("conv_id", "turn", "text", seq.alias("seq")).select("conv_id", "turn", "seq", F.substr(F.col("text"), F.col("seq"), F.lit(1)).alias("token"))


@BOOK.query("SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st6_windowed_metrics(spark, sf):
    from ..streaming.metrics import hourly

    return hourly(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@BOOK.query()
def st3_rate_limit(spark, sf):
    from ..streaming.limits import rate_limit

    return rate_limit(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", most=3, seconds=3600)
