"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, infill, langid, license_scan, mil_quality, mixing, quality_rules, sharding, simhash, spelling, surrogates, vector_graph
from .tables import documents, table
from .token_count import count_tokens


def op8_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.classify(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang"), ["doc_id"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    names = F.array_join(F.transform("matches", lambda m: m["license"]), ",")
    return found.select("doc_id", "n_blocks", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"), "matches")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), ["doc_id"])
    return rows.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quillgraph.surrogateKey", "key of the fixture tables")
    return surrogates.replace(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], key.encode())


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(found)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"]))


def op12_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_simhash_near_dedup, op4_quality_rules, op5_pii_surrogates, op6_feistel_shards, op7_decontamination, op8_mil_quality, op9_source_mix, op10_token_counts, op11_fill_in_middle, op12_vector_near_dedup, op13_spelling_variants, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_source_mix": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_vector_near_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}


#: Windows of both sides as joined words, matched as text; positions covered by any match are counted once.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)
), hits AS (SELECT doc_id, k, i, item_id FROM windows JOIN grams USING (k, g)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Base figures by unnesting words and lines; bounds from the same binned quartiles, written as plain aggregations.
OP4_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) >= 2 AS hit FROM g
), cover AS (
  SELECT doc_id, count(*) AS n_words,
         count(*) FILTER (WHERE hit OR h1 OR h2) AS n_repeat_words
  FROM (SELECT doc_id, hit, coalesce(lag(hit, 1) OVER p, false) AS h1, coalesce(lag(hit, 2) OVER p, false) AS h2
        FROM twice WINDOW p AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), b AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(cover.n_words, 0) AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(cover.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM documents d LEFT JOIN cover USING (doc_id) LEFT JOIN l USING (doc_id)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbol_ratio, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_ratio,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_ratio, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM b
), v AS (
  SELECT lang, source, ratio, CAST(value AS BIGINT) AS value, greatest(0, length(bin(CAST(value AS BIGINT))) - 7) AS s
  FROM (UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, repeat_ratio, word_length FROM r WHERE NOT base_failed)
        ON symbol_ratio, dup_line_ratio, repeat_ratio, word_length INTO NAME ratio VALUE value)
), binned AS (SELECT lang, source, ratio, (value >> s) << s AS bin FROM v
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total
  FROM (SELECT 0 AS level, lang, source, ratio, bin, count(*) AS n FROM binned GROUP BY ALL
        UNION ALL SELECT 1, lang, NULL, ratio, bin, count(*) FROM binned GROUP BY ALL
        UNION ALL SELECT 2, NULL, NULL, ratio, bin, count(*) FROM binned GROUP BY ALL)
), levels(ratio, a, b, k) AS (VALUES ('symbol_ratio', 50, 85, 3), ('dup_line_ratio', 90, 99, 2), ('repeat_ratio', 90, 99, 2), ('word_length', 25, 75, 5)
), q AS (
  SELECT level, lang, source, ratio, k, total, min(bin) FILTER (WHERE upto * 100 >= total * a) AS qa, min(bin) FILTER (WHERE upto * 100 >= total * b) AS qb
  FROM cum JOIN levels USING (ratio) GROUP BY level, lang, source, ratio, k, total
), bounds AS (
  SELECT g.lang, g.source, g.ratio, arg_min(qb + (qb - qa) * k, level) AS hi, arg_min(qa - (qb - qa) * k, level) AS lo
  FROM (SELECT DISTINCT lang, source, ratio FROM binned) g
  JOIN q ON q.ratio = g.ratio AND (q.level = 2 OR q.total >= 100 AND q.lang IS NOT DISTINCT FROM g.lang AND (q.level = 1 OR q.source IS NOT DISTINCT FROM g.source))
  GROUP BY g.lang, g.source, g.ratio
), out_of AS (
  SELECT DISTINCT doc_id
  FROM (SELECT doc_id, lang, source, 'symbol_ratio' AS ratio, n_symbols AS n, word_chars AS size, symbol_ratio AS value FROM r
        UNION ALL SELECT doc_id, lang, source, 'dup_line_ratio', n_dup_lines, n_lines, dup_line_ratio FROM r
        UNION ALL SELECT doc_id, lang, source, 'repeat_ratio', n_repeat_words, n_words, repeat_ratio FROM r
        UNION ALL SELECT doc_id, lang, source, 'word_length', word_chars, n_words, word_length FROM r) u
  JOIN bounds t ON u.lang IS NOT DISTINCT FROM t.lang AND u.source IS NOT DISTINCT FROM t.source AND u.ratio = t.ratio
  WHERE CASE WHEN u.ratio = 'word_length' THEN value > hi OR value < lo
             ELSE n > hi * size / CAST(1000 AS DOUBLE) + sqrt(hi * size / CAST(1000 AS DOUBLE)) * 3 + 3 END
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out_of) AS kept
FROM r
"""


#: Word counts, water-filled targets by repeated resharing, the schedule by a range join of golden-ratio points, and each document's part and slot from the blocks of its source's repeated line.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source
), fill(round, level) AS (
  SELECT 0, (SELECT 1.5 * sum(source_size) / sum(weight) FROM s)
  UNION ALL
  SELECT round + 1, (SELECT (sum(1.5 * source_size) - coalesce(sum(2.0 * source_size) FILTER (WHERE weight * f.level >= 2 * source_size), 0))
                            / nullif(sum(weight) FILTER (WHERE weight * f.level < 2 * source_size), 0) FROM s)
  FROM fill f WHERE round < 200 AND level IS NOT NULL
), lvl AS (SELECT max(level) AS level, bool_or(level IS NULL) AS full_up FROM fill
), t AS (
  SELECT *, CAST(round(target) AS BIGINT) AS tokens, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM (SELECT source, source_size, CAST(CASE WHEN full_up THEN 2.0 * source_size ELSE least(2.0 * source_size, weight * level) END AS DOUBLE) AS target FROM s, lvl)
), total AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, greatest(1, CAST(ceil(sum(tokens) / (count(*) * 65536.0)) AS BIGINT)) AS block FROM t
), bounds AS (
  SELECT sid, CAST(sum(tokens) OVER (ORDER BY sid) AS DOUBLE) / total AS hi, CAST(sum(tokens) OVER (ORDER BY sid) - tokens AS DOUBLE) / total AS lo
  FROM t, total WHERE tokens > 0
), slots AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, slot * CAST(0.6180339887498949 AS DOUBLE) - floor(slot * CAST(0.6180339887498949 AS DOUBLE)) AS u
        FROM (SELECT unnest(range((SELECT CAST(ceil(total / CAST(block AS DOUBLE)) AS BIGINT) FROM total))) AS slot)) p
  JOIN bounds ON u >= lo AND u < hi
), given AS (SELECT sid, count(*) AS n FROM slots GROUP BY sid
), p AS (
  SELECT t.*, block, least(tokens, block * greatest(least(greatest(coalesce(n, 0), tokens // block), (tokens + block - 1) // block), least(1, tokens))) AS give
  FROM t CROSS JOIN total LEFT JOIN given USING (sid)
), line AS (
  SELECT d.doc_id, d.size, p.sid, p.source_size, p.target, p.give, p.block,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE size * (give // source_size) + greatest(0, least(first + size, give % source_size) - first) END AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 AND first < give THEN coalesce(slot, 1099511627776 + first // block) END AS BIGINT) AS slot
FROM line LEFT JOIN slots ON slots.sid = line.sid AND slots.rank = line.first // line.block
"""


#: Units as a list, cut at the drawn ranks.
OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), d AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), r AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR h3 % 100 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


#: The checksum byte by byte over each run's hexadecimal form, candidates by shared deletions, distances by the engine's own function, roots by recursion.
OP13_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), step AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), r AS (
  SELECT id, run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), x AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS hx FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || hx[i:i + 1] AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc FROM x, step
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN crc % 199 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), k AS (
  SELECT DISTINCT word, n, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)), word)) AS key FROM w
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b USING (key) WHERE a.word <> b.word
), exact AS (
  SELECT * FROM near WHERE abs(length(word) - length(other)) <= 1 AND len(list_filter(range(0, length(word) + 1), lambda i:
    left(word, i) = left(other, i) AND CASE length(word) - length(other) WHEN 0 THEN substr(word, i + 2) = substr(other, i + 2) WHEN 1 THEN substr(word, i + 2) = substr(other, i + 1) ELSE substr(word, i + 1) = substr(other, i + 2) END)) > 0
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM exact GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)
), up(word, root, depth) AS (
  SELECT word, word, 0 FROM f
  UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, u.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word) u USING (word)
"""


#: All pairs, and classes by recursion over the links.
OP12_SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM l
  UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""
