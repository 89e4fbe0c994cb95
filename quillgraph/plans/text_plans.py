"""Queries on text: terms, statistics, filters, projections (K*, A1-A6, FLT*, F*, PRJ*, C1, C6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import filters, tfidf
from .kit import Book, made_of, table, text_index, texts

BOOK = Book()
queries, oracle_sql = BOOK.queries, BOOK.oracle_sql

_FOLD = "replace(lower({}), 'ß', 'ss')"
_TERMS = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: replace(lower(t), 'ß', 'ss')))"
_POST = f"WITH p AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), n AS (SELECT greatest(count(*) FILTER (WHERE trim(coalesce(text, '')) <> ''), 1) AS n FROM documents), f AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM p, n GROUP BY term)"
_BOOST = "(1.0 + least(length(term), 8) / 8.0)"
_STOPS = "(" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + ")"


def docs(spark, sf):
    return texts(spark, sf)


@BOOK.query(f"SELECT doc_id, len({_TERMS}) AS n_terms, md5(array_to_string(list_sort({_TERMS}), ' ')) AS terms_md5 FROM documents")
def k1_extract_terms(spark, sf):
    t = X.terms(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(t).alias("n_terms"), F.md5(F.array_join(F.array_sort(t), " ").cast("binary")).alias("terms_md5"))


@BOOK.query(f"{_POST} SELECT term, df FROM f")
def a1_document_frequency(spark, sf):
    return tfidf.idf_table(docs(spark, sf)).select("term", "df")


@BOOK.query(f"{_POST} SELECT term, round(idf, 6) AS idf FROM f")
def a2_idf(spark, sf):
    return tfidf.idf_table(docs(spark, sf)).select("term", F.round("idf", 6).alias("idf"))


@BOOK.query(f"WITH p AS (SELECT DISTINCT source AS key, unnest({_TERMS}) AS term FROM documents), g AS (SELECT count(*) FILTER (WHERE trim(coalesce(source, '')) = '') AS unnamed, count(DISTINCT source) AS keys FROM documents) SELECT term, count(*) AS df, round(ln((1.0 + any_value(keys)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM p, g WHERE unnamed = 0 AND keys >= 3 GROUP BY term")
def a3_cross_document_profile(spark, sf):
    return tfidf.source_profile(docs(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


@BOOK.query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN {_STOPS} GROUP BY word ORDER BY n DESC, word LIMIT 10")
def a4_frequent_words(spark, sf):
    return tfidf.frequent_words(docs(spark, sf))


_RANKED = f"{_POST}, s AS (SELECT doc_id, term, idf, idf * {_BOOST} AS score FROM p JOIN f USING (term) WHERE idf >= 1.2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, round(idf, 9) DESC, length(term) DESC, term) AS rank FROM s)"


@BOOK.query(f"{_RANKED} SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 8")
def k2_rank_keywords(spark, sf):
    return tfidf.top_keywords(tfidf.indexed_terms(text_index(spark, sf))).select("doc_id", "term", "rank", F.round("score", 6).alias("score"))


@BOOK.query(f"{_RANKED}, t AS (SELECT doc_id, sum(score) AS total FROM r WHERE rank <= 8 GROUP BY doc_id) SELECT doc_id, round(coalesce(total / sqrt(greatest(len({_TERMS}), 1)), 0), 6) AS signal FROM documents LEFT JOIN t USING (doc_id)")
def a5_text_signal(spark, sf):
    return tfidf.signal_scores(docs(spark, sf)).select("doc_id", F.round("signal", 6).alias("signal"))


@BOOK.query(f"{_POST}, b AS (SELECT doc_id, max(idf) AS idf FROM p JOIN f USING (term) GROUP BY doc_id) SELECT doc_id, round(coalesce(idf, 0), 6) AS best_idf FROM documents LEFT JOIN b USING (doc_id)")
def a6_best_idf(spark, sf):
    return tfidf.best_idf(docs(spark, sf)).select("doc_id", F.round("best_idf", 6).alias("best_idf"))


_ABBR = "CASE WHEN len(regexp_extract_all(p_name, '[A-Za-z0-9]+')) < 2 THEN '' ELSE lower(array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda w: left(w, 1)), '')) END"
_SIG = "regexp_replace(regexp_replace(replace(lower(trim({0})), 'ß', 'ss'), '[\\s\\-_/.]+', '', 'g'), '[^0-9a-z]+', '', 'g')"


@BOOK.query(f"SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g')) AS name_normal, {_SIG.format('p_brand')} AS signature, {_ABBR} AS abbreviation FROM part")
def k3_name_signatures(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.name_normal(F.col("p_name")).alias("name_normal"), X.alias_signature(F.col("p_brand")).alias("signature"), X.abbreviation(F.col("p_name")).alias("abbreviation"))


_ALIASES = "(SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN upper(left(p_name, 1)) || upper(left(split_part(p_name, ' ', 2), 1)) WHEN 1 THEN '高血压' WHEN 2 THEN p_name WHEN 3 THEN p_brand ELSE '阿司匹林' || p_partkey END AS alias, CASE WHEN p_partkey % 3 = 0 THEN '阿司匹林片' ELSE p_name END AS name FROM part)"


@BOOK.query("SELECT p_partkey, abbr, NOT abbr AND cjk_a <> cjk_n AND lat_a <> lat_n AS cross_language FROM (SELECT p_partkey, regexp_matches(trim(alias), '^[A-Za-z0-9]{2,10}$') AND len(regexp_extract_all(name, '[A-Za-z0-9]+')) >= 2 AND lower(trim(alias)) = lower(array_to_string(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda w: left(w, 1)), '')) AS abbr, regexp_matches(alias, '[一-鿿]') AS cjk_a, regexp_matches(name, '[一-鿿]') AS cjk_n, regexp_matches(alias, '[A-Za-z]') AS lat_a, regexp_matches(name, '[A-Za-z]') AS lat_n FROM " + _ALIASES + ")")
def k4_alias_scripts(spark, sf):
    return made_of(spark, sf, _ALIASES).select("p_partkey", X.abbreviation_alias(F.col("alias"), F.col("name")).alias("abbr"), X.cross_language_alias(F.col("alias"), F.col("name")).alias("cross_language"))


@BOOK.query(f"SELECT p_partkey, len(list_distinct(list_transform(list_filter([trim(p_name), {_SIG.format('p_name')}, trim(p_brand), {_SIG.format('p_brand')}], lambda x: length(x) >= 2), lambda x: lower(x)))) AS n_forms FROM part")
def k5_surface_forms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(X.surface_forms(F.col("p_name"), F.array("p_brand"))).alias("n_forms"))


@BOOK.query("WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda x: length(x) >= 2), lambda x: lower(x)) AS w FROM documents) SELECT doc_id, len(list_distinct(list_filter(list_concat(w, list_transform(w, lambda x: regexp_replace(regexp_replace(x, '[-_]+', '', 'g'), '[^0-9a-z]+', '', 'g'))), lambda x: x <> ''))) AS n_signatures FROM t")
def f3_token_signatures(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.token_signatures(F.col("text"))).alias("n_signatures"))


_WORDS_OF_INTEREST = ("heen", "reing", "license", "keit", "en de")


_F1_ROWS = f"""
WITH f(form) AS (VALUES ('heen'), ('reing'), ('license'), ('keit'), ('en de')),
x AS (SELECT doc_id, form, coalesce(text, '') AS text, {_FOLD.format("coalesce(text, '')")} AS low FROM documents, f),
y AS (SELECT *, len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^0-9a-z_])', '\\1\\1', 'g') || ' ', '(?:^|[^0-9a-z_])' || regexp_replace(form, ' ', '  ', 'g') || '(?:[^0-9a-z_]|$)')) AS words FROM x),
scored AS (SELECT doc_id, form, CASE WHEN words > 0 THEN least(words, 3) * greatest(1.0, length(form) / 5.0)
  WHEN length(form) > 4 AND contains(low, form) THEN greatest(0.5, length(form) / 12.0)
  WHEN length({_SIG.format('form')}) >= 5 AND contains({_SIG.format('text')}, {_SIG.format('form')}) THEN greatest(0.8, length({_SIG.format('form')}) / 10.0)
  WHEN form = 'en de' AND list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda t: lower(t)), 'ed') THEN 0.95
  ELSE 0 END AS score FROM y)"""


@BOOK.query(_F1_ROWS + " SELECT doc_id, round(max(score), 6) AS score FROM scored GROUP BY doc_id")
def f1_mention_score(spark, sf):
    forms = F.array(*map(F.lit, _WORDS_OF_INTEREST))
    return docs(spark, sf).select("doc_id", F.round(X.mention_score(X.text_or_empty(F.col("text")), forms), 6).alias("score"))


@BOOK.query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？.!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s")
def f8_sentences(spark, sf):
    s = X.sentences(F.col("text"))
    return docs(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


_CHARS = "regexp_replace(coalesce(text, ''), '\\s+', '', 'g')"
_INFO = f"""(CASE WHEN length({_CHARS}) = 0 THEN 0.0 ELSE
  (CASE WHEN length({_CHARS}) >= 24 THEN 1.0 ELSE 0 END) + (CASE WHEN len(list_distinct(string_split({_CHARS}, ''))) / length({_CHARS}) >= 0.35 THEN 1.0 ELSE 0 END)
  + (CASE WHEN len(tok) = 0 OR len(list_filter(tok, lambda t: t IN {_STOPS})) / len(tok) <= 0.65 THEN 1.0 ELSE 0 END)
  + (CASE WHEN (length({_CHARS}) - length(regexp_replace({_CHARS}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g'))) / length({_CHARS}) <= 0.55 THEN 1.0 ELSE 0 END)
  + (CASE WHEN length(regexp_replace({_CHARS}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length({_CHARS}) >= 0.35 THEN 1.0 ELSE 0 END) END)"""
_TOK = "(SELECT *, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[A-Za-z]+') AS tok FROM documents)"


@BOOK.query(f"SELECT doc_id, CAST({_INFO} AS DOUBLE) AS score FROM {_TOK}")
def flt2_information_score(spark, sf):
    return docs(spark, sf).select("doc_id", X.information_score(F.col("text")).alias("score"))


_FACT = "(regexp_matches({0}, '[A-Za-z][A-Za-z0-9/+.-]*\\s*(?:<|>|<=|>=|≤|≥|=)\\s*\\d') OR regexp_matches({0}, '\\d+(?:\\.\\d+)?\\s*(?:μg|ug|mg|g|ml|mL|%|次|/μL|/uL|mL/min|ml/min)') OR regexp_matches({0}, '(?:每日|每天|每周)\\s*\\d+\\s*次'))"


@BOOK.query(f"SELECT doc_id, {_FACT.format('coalesce(text, chr(32))')} AS strong FROM documents")
def flt3_strong_fact_shape(spark, sf):
    return docs(spark, sf).select("doc_id", X.strong_fact_shape(F.col("text")).alias("strong"))


_NORM = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@BOOK.query(f"SELECT doc_id, length(n) <= 12 AND n <> '' AND count(*) OVER (PARTITION BY n) >= 2 AS short_repeat FROM (SELECT doc_id, {_NORM} AS n FROM documents)")
def flt4_short_repeats(spark, sf):
    return filters.short_repeats(docs(spark, sf)).select("doc_id", "short_repeat")


@BOOK.query(f"WITH x AS (SELECT doc_id, {_NORM} AS n, length({_CHARS}) = 0 AS blank FROM documents), y AS (SELECT doc_id, {_FACT.format('n')} OR NOT ((n <> '' AND length(n) <= 12 AND count(*) OVER (PARTITION BY n) >= 2) OR blank) AS k FROM x) SELECT doc_id, k OR NOT (SELECT bool_or(k) FROM y) AS kept FROM y")
def flt1_low_information(spark, sf):
    return filters.low_information(docs(spark, sf)).select("doc_id", "kept")


@BOOK.query("""WITH s AS (SELECT doc_id, list_filter(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。！？!?；;])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: contains(lower(x), 'the'))[1] AS s FROM documents),
p AS (SELECT doc_id, s, strpos(lower(s), 'the') AS pos FROM s), q AS (SELECT doc_id, lower(substr(s, greatest(pos - 18, 1), least(pos - 1, 18))) AS pre, lower(substr(s, pos, 9)) AS suf FROM p)
SELECT doc_id, coalesce(contains(pre, 'of ') OR contains(suf, 'of ') OR contains(pre, 'by ') OR contains(suf, 'by '), false) AS negated FROM q""")
def flt5_negation_scope(spark, sf):
    return docs(spark, sf).select("doc_id", filters.negated(F.col("text"), "the", ("of ", "by ")).alias("negated"))


_CAND = "(SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '- ' || p_name || ' ->' WHEN 1 THEN '(' || p_name || ')' WHEN 2 THEN '-->' WHEN 3 THEN '剂量' WHEN 4 THEN '  ' || p_name || '，' WHEN 5 THEN 'a' WHEN 6 THEN p_size || '.5' WHEN 7 THEN '>>' WHEN 8 THEN '* ' || p_name WHEN 9 THEN '--' || p_brand ELSE p_name || '  ' || p_brand END AS raw FROM part)"


@BOOK.query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[ ,.;:()\\[\\]{}，。；：、]+|[ ,.;:()\\[\\]{}，。；：、]+$', '', 'g'), '^(?:[-*•]+|[—–]+|>)+\\s*', ''), '\\s*(?:[-*•]+|[—–]+|>)+$', ''), '^(?:--+|[-=]+>)\\s*', ''), '\\s*(?:--+|[-=]+>)$', ''), '^[ ,.;:()\\[\\]{}，。；：、]+|[ ,.;:()\\[\\]{}，。；：、]+$', '', 'g') AS cleaned, trim(raw) = '' OR lower(trim(raw)) IN ('-', '--', '->', '-->') OR raw LIKE '--%' OR raw LIKE '->%' OR raw LIKE '- %' OR raw LIKE '%--' OR raw LIKE '%->' OR raw LIKE '% -' OR regexp_full_match(raw, '[-*•>\\s]+') OR regexp_replace(raw, '\\s+', '', 'g') IN ('不良反应', '处理措施', '替代方案', '关键事实', '优势', '剂量', '起效时间', '持续时间', '推荐治疗') AS noisy FROM " + _CAND)
def flt6_candidate_noise(spark, sf):
    r = F.col("raw")
    return made_of(spark, sf, _CAND).select("p_partkey", filters.strip_noise(r).alias("cleaned"), filters.noisy(r).alias("noisy"))


@BOOK.query(f"SELECT p_partkey, length(t) BETWEEN 2 AND 40 AND NOT regexp_full_match(t, '[0-9]+(\\.[0-9]+)?') AND len(list_distinct(string_split(t, ''))) > 1 AS valid FROM (SELECT p_partkey, trim(p_name) AS t FROM part)")
def flt7_valid_phrases(spark, sf):
    t = F.trim("p_name")
    return table(spark, sf, "part").select("p_partkey", (F.length(t).between(2, 40) & ~t.rlike("^[0-9]+(\\.[0-9]+)?$") & (F.size(F.array_distinct(F.split(t, ""))) > 1)).alias("valid"))


_COMMON = "(" + ", ".join(f"'{w}'" for w in L.COMMON_ENTITY_NAMES) + ")"


@BOOK.query(f"{_POST}, e AS (SELECT DISTINCT term AS name FROM f) SELECT name, length(name) < 2 OR (n >= 3 AND idf > 0 AND idf < 1.2 AND df / n >= 0.8) OR name IN {_COMMON} AS skip FROM e JOIN f ON term = name, n")
def flt8_skip_entities(spark, sf):
    d = docs(spark, sf)
    rows = tfidf.idf_table(d).join(F.broadcast(tfidf.document_count(d)), F.lit(True))
    name = F.col("term")
    skip = (F.length(name) < 2) | ((F.col("n") >= 3) & (F.col("idf") > 0) & (F.col("idf") < 1.2) & (F.col("df") / F.col("n") >= 0.8)) | name.isin(*L.COMMON_ENTITY_NAMES)
    return rows.select(name.alias("name"), skip.alias("skip"))


@BOOK.query("SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '([^0-9A-Za-z_])', '\\1\\1', 'g') || ' ', '(?i)(?:^|[^0-9A-Za-z_])the(?:[^0-9A-Za-z_]|$)')) > 0 AS contained FROM documents")
def flt9_surface_containment(spark, sf):
    return docs(spark, sf).select("doc_id", X.contains_surface(X.text_or_empty(F.col("text")), F.lit("the")).alias("contained"))


_HINTS = ", ".join(f"'{w}'" for w in L.MEDICAL_HINTS)


@BOOK.query(f"SELECT p_partkey, p_type IN ('LARGE', 'ECONOMY') OR len(list_filter([{_HINTS}], lambda h: contains(lower(p_name), h))) > 0 AS salient FROM part")
def flt10_salient_entities(spark, sf):
    hints = F.array(*map(F.lit, L.MEDICAL_HINTS))
    return table(spark, sf, "part").select("p_partkey", (F.col("p_type").isin("LARGE", "ECONOMY") | F.exists(hints, lambda h: F.contains(F.lower("p_name"), h))).alias("salient"))


@BOOK.query("SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '\\d') OR (length(coalesce(text, '')) >= 80 AND len(regexp_extract_all(coalesce(text, ''), '[,;，；、]')) >= 2) AS verifiable FROM conversations")
def flt12_verifiable_answers(spark, sf):
    t = X.text_or_empty(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (t.rlike("\\d") | ((F.length(t) >= 80) & (F.regexp_count(t, F.lit("[,;，；、]")) >= 2))).alias("verifiable"))


@BOOK.query("SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '\\b(all|list|every|each|alle|tous|todos)\\b') AS enumeration FROM conversations")
def flt13_enumeration_queries(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lower(X.text_or_empty(F.col("text"))).rlike("\\b(all|list|every|each|alle|tous|todos)\\b").alias("enumeration"))


@BOOK.query("SELECT conv_id, turn, length(trim(coalesce(text, ''))) <= 12 OR contains(lower(coalesce(text, '')), 'it') OR contains(lower(coalesce(text, '')), 'that') AS follow_up FROM conversations WHERE role = 'user'")
def flt14_follow_ups(spark, sf):
    t = X.text_or_empty(F.col("text"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", ((F.length(F.trim(t)) <= 12) | F.contains(F.lower(t), F.lit("it")) | F.contains(F.lower(t), F.lit("that"))).alias("follow_up"))


@BOOK.query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) = '' ")
def flt15_empty_generations(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").where(F.trim(X.text_or_empty(F.col("text"))) == "").select("conv_id", "turn")


@BOOK.query("SELECT doc_id, strpos(coalesce(text, ''), w) - 1 AS start, substr(coalesce(text, ''), strpos(coalesce(text, ''), w), length(w)) = w AS valid FROM (SELECT doc_id, text, regexp_extract(coalesce(text, ''), '[A-Z][a-z]+') AS w FROM documents) WHERE w <> ''")
def flt18_offset_validation(spark, sf):
    d = docs(spark, sf).select("doc_id", X.text_or_empty(F.col("text")).alias("t"), F.regexp_extract(X.text_or_empty(F.col("text")), "[A-Z][a-z]+", 0).alias("w")).where("w <> ''")
    return d.select("doc_id", (F.expr("position(w, t)") - 1).alias("start"), (F.expr("substr(t, position(w, t), length(w))") == F.col("w")).alias("valid"))


@BOOK.query("SELECT doc_id, CASE WHEN source <> '' THEN source || chr(10) || chr(10) || text ELSE text END AS enriched FROM documents")
def prj1_enriched_content(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(F.col("source") != "", F.concat_ws("\n\n", "source", "text")).otherwise(F.col("text")).alias("enriched"))


@BOOK.query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT source, left(string_agg(text, ' ' ORDER BY i) FILTER (WHERE i <= 2), 320) AS summary FROM c GROUP BY source) SELECT doc_id, md5(summary) AS summary_md5, source AS section, concat(i, '/', n) AS position, left(text, 220) AS focus FROM c JOIN s USING (source)")
def prj2_light_context(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "text")
    # positions by a prefix count over id ranges would need no window per source; sources here are sections of bounded size
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = d.withColumn("i", i)
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    head = rows.where("i <= 2").groupBy("source").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " "), F.lit(320)).alias("summary"))
    out = rows.join(n, "source").join(head, "source")
    return out.select("doc_id", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), F.col("source").alias("section"), F.concat_ws("/", "i", "n").alias("position"), F.left("text", F.lit(220)).alias("focus"))


@BOOK.query("SELECT conv_id, turn, len(list_filter(list_transform(string_split(coalesce(text, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS n_evidences FROM conversations")
def prj8_split_evidence(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.filter(F.transform(F.split(X.text_or_empty(F.col("text")), ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("n_evidences"))


@BOOK.query("SELECT event_id, CASE event_type WHEN 'view' THEN 'simple' WHEN 'click' THEN 'relation' WHEN 'purchase' THEN 'multi_hop' ELSE event_type END AS query_type FROM events")
def prj9_query_type_names(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in (("view", "simple"), ("click", "relation"), ("purchase", "multi_hop")) for x in pair))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("query_type"))


@BOOK.query("SELECT url, trim(regexp_replace(regexp_replace(url, '[+\\-!(){}\\[\\]^\"~*?:\\\\/&|]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM pages")
def f31_lucene_sanitise(spark, sf):
    return table(spark, sf, "pages").select("url", X.sanitize_lucene(F.col("url")).alias("cleaned"))


@BOOK.query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def f32_slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.btrim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


@BOOK.query("SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b[A-Z][A-Za-z0-9-]{2,}'))) AS n_entities FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'a', 'g') AS text FROM documents)")
def f33_entity_estimate(spark, sf):
    d = docs(spark, sf).select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "a").alias("text"))
    return d.select("doc_id", X.entity_estimate(F.col("text")).alias("n_entities"))


@BOOK.query("SELECT doc_id, substr(md5(coalesce(text, '')), 1, 8) AS short_id, md5(concat_ws('|', doc_id, source, lang)) AS stable_id FROM documents")
def f30_stable_ids(spark, sf):
    return docs(spark, sf).select("doc_id", F.left(F.md5(X.text_or_empty(F.col("text")).cast("binary")), F.lit(8)).alias("short_id"), F.md5(F.concat_ws("|", "doc_id", "source", "lang").cast("binary")).alias("stable_id"))


@BOOK.query("SELECT doc_id, i AS piece, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM documents, generate_series(0, CAST(floor((length(text) - 1) / 800.0) AS BIGINT)) AS g(i) WHERE length(text) > 0")
def c6_fixed_windows(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.fixed_windows(F.col("text"), 1000, 200)).alias("piece", "content")).select("doc_id", F.col("piece").cast("long").alias("piece"), "content")


_FACTS = "(SELECT CASE p_partkey % 7 WHEN 0 THEN 'eGFR ≥ ' || p_size || ' mL/min, 每日2次' WHEN 1 THEN '剂量 5.0 mg 每周三次: ' || p_name WHEN 2 THEN '发生率 ' || p_size || '％' WHEN 3 THEN '3次/周 且 <' || p_size WHEN 4 THEN p_size || ' 个月' WHEN 5 THEN p_size || 'ug' ELSE p_name END AS t FROM part)"


@BOOK.query("""WITH n AS (SELECT t, regexp_replace(replace(replace(translate(replace(lower(t), 'ß', 'ss'), '（），％–—－', '(),%---'), '≤', '<='), '≥', '>='), '\\s+', '', 'g') AS x FROM """ + _FACTS + """),
k AS (SELECT t, unnest(list_concat(
  list_transform(regexp_extract_all(x, '(?:每日|每天|每)(\\d+(?:\\.\\d+)?|[一二两三四五六七八九十])次', 1), lambda v: 'frequency:' || v || ':day'),
  list_transform(regexp_extract_all(x, '(\\d+(?:\\.\\d+)?|[一二两三四五六七八九十])次/(?:日|天|day|d)', 1), lambda v: 'frequency:' || v || ':day'),
  list_transform(regexp_extract_all(x, '(?:每周|每星期|每礼拜|每)(\\d+(?:\\.\\d+)?|[一二两三四五六七八九十])次', 1), lambda v: 'frequency:' || v || ':week'),
  list_transform(regexp_extract_all(x, '(\\d+(?:\\.\\d+)?|[一二两三四五六七八九十])次/(?:周|星期|礼拜|week|w)', 1), lambda v: 'frequency:' || v || ':week'),
  list_transform(regexp_extract_all(x, '(?:<=|>=|<|>|=)\\d+(?:\\.\\d+)?'), lambda m: 'comparison:' || regexp_replace(m, '^[<>=]+', '') || ':' || regexp_extract(m, '^[<>=]+')),
  list_transform(regexp_extract_all(x, '\\d+(?:\\.\\d+)?(?:%|mg|ml|mmol|μg|ug|pg|g/l|iu|分钟|小时|个月|天|年)'), lambda m: 'quantity:' || regexp_extract(m, '^[0-9.]+') || ':' || replace(regexp_replace(m, '^[0-9.]+', ''), 'ug', 'μg'))
)) AS k FROM n)
SELECT DISTINCT t, regexp_replace(replace(replace(replace(k, ':三:', ':3:'), ':二:', ':2:'), '5.0', '5'), '\\.0$', '') AS fact FROM k""")
def f19_quantitative_facts(spark, sf):
    return made_of(spark, sf, _FACTS).distinct().select("t", F.explode(X.quantitative_facts(F.col("t"))).alias("fact"))
