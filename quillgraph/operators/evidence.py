"""Evidence of graph and vector results: source text, quality, hits, windows, ranking, packing (F12, PRJ6, R5, R15, W10, W15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import drop_near_copies, lexical_confidence

# Prefixes of indexing hints, marks of list lines, and words that keep a list line in a window.
HINT_PREFIXES = ("Document summary:", "Section:", "Chunk position:", "Focus:")
LIST_MARKS = ("-", "*", "•")
ACTION_WORDS = ("至少", "禁用", "改用", "目标", "疗程", "剂量")


def _starts(line: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(line, F.lit(m))
    return out


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(X.text_or_empty(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def source_text(passage: Column) -> Column:
    """what follows the first blank line, if anything does; else the lines after leading indexing hints."""
    text = F.btrim(X.text_or_empty(passage), F.lit(" \t\n\r"))
    body = F.btrim(F.regexp_extract(text, "(?s)\\n[ \\t]*\\n(.*)$", 1), F.lit(" \t\n\r"))
    lines = _lines(text)
    first = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(~_starts(x, HINT_PREFIXES), i)), lambda i: i.isNotNull())), F.size(lines))
    rest = F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))), "\n")
    return F.when(body != "", body).when(rest != "", rest).otherwise(text)


def source_quality(text: Column) -> Column:
    """share of list, table and prose lines less the share of generated ones; 0 for a blank text."""

    def score(lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test))
        made = count(lambda x: F.contains(x, F.lit("--")) & F.contains(x, F.lit("-->"))) + count(lambda x: F.contains(x, F.lit("aliases:")))
        listed = count(lambda x: _starts(x, (*LIST_MARKS, "|", "#")))
        prose = count(lambda x: ~_starts(x, (*LIST_MARKS, "|")) & ~F.contains(x, F.lit("aliases:")))
        return F.when(F.size(lines) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (listed + prose) / F.size(lines) - made / F.size(lines)))

    return X.let(_lines(text), score)


def term_hits(text: Column, terms: Column) -> Column:
    """how many folded terms the text holds."""
    return F.size(F.filter(terms, lambda t: F.contains(X.fold(text), t)))


def sentence_window(sentences: Column, at: Column, terms: Column) -> Column:
    """The sentence at 0-based ``at`` with its heading before and up to three following hits.

    A list line takes the nearest heading within seven lines before it, past
    other list lines; a prose line takes a previous line that holds a full-width
    colon and is short or ends with a colon.  Following lines count while they
    hit a term or are list lines with an action word; the first other one ends it.
    """
    get = lambda i: F.try_element_at(sentences, i + 1)
    listed = lambda x: _starts(F.ltrim(x), LIST_MARKS)
    headed = lambda x: x.rlike("[:：]$")
    back = F.filter(F.sequence(F.greatest(at - 7, F.lit(0)), F.greatest(at - 1, F.lit(0))), lambda i: (i < at) & ~listed(get(i)) & headed(get(i)))
    before = F.when(listed(get(at)), F.when(F.size(back) > 0, get(F.array_max(back)))).when((at > 0) & (headed(get(at - 1)) | (F.length(get(at - 1)) <= 40)) & F.contains(get(at - 1), F.lit("：")), get(at - 1))
    action = lambda x: F.exists(F.array(*map(F.lit, ACTION_WORDS)), lambda w: F.contains(x, w))
    follows = lambda x: F.coalesce((term_hits(x, terms) > 0) | (listed(x) & action(x)), F.lit(False))
    one = follows(get(at + 1))
    two = one & follows(get(at + 2))
    three = two & follows(get(at + 3))
    return F.concat_ws(" ", before, get(at), F.when(one, get(at + 1)), F.when(two, get(at + 2)), F.when(three, get(at + 3)))


def rank_graph_passages(passages: DataFrame, context: DataFrame, k: int) -> DataFrame:
    """A question's graph passages by five keys, as results with score 1/rank.

    ``passages(query_id, chunk_id, base_rank, text)``; ``context(query_id, terms,
    entities, triplets)`` with folded strings, triplets as (source, target).
    Keys: any signal, term coverage, source quality, matched triplets, matched
    entities plus confidence; all descending, then the base rank.  The result
    lists are bounded by ``k``, a question's passages come from its own search.
    """
    rows = passages.join(context, "query_id").withColumn("evidence", source_text(F.col("text")))
    rows = rows.withColumn("__low", X.fold("evidence")).withColumn("__n", F.size("terms"))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("__low"), t)))
    rows = rows.withColumn("__hits", hits).withColumn("__paths", F.size(F.filter("triplets", lambda t: F.contains(F.col("__low"), t["source"]) & F.contains(F.col("__low"), t["target"]))))
    rows = rows.withColumn("__named", F.size(F.filter("entities", lambda e: F.contains(F.col("__low"), e))))
    coverage = F.when(F.col("__n") > 0, F.col("__hits") / F.col("__n")).otherwise(0.0)
    signal = graph_confidence(1.0 / F.greatest("base_rank", F.lit(1)), F.col("__hits"), F.col("__n"))
    keys = [((F.col("__hits") > 0) | (F.col("__paths") > 0)).cast("int"), F.round(coverage, 9), F.round(source_quality(F.col("evidence")), 9), F.col("__paths"), F.round(F.col("__named") + signal, 9)]
    order = Window.partitionBy("query_id").orderBy(*(F.desc(x) for x in keys), "base_rank", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = 1.0 / F.col("rank")
    return rows.select("query_id", "chunk_id", score.alias("score"), graph_confidence(score, F.col("__hits"), F.col("__n")).alias("score_normalized"), "rank", F.lit("graph").alias("source"), F.col("evidence").alias("content"))


def graph_confidence(base: Column, hits: Column, n_terms: Column) -> Column:
    return lexical_confidence(F.greatest(F.lit(0.0), F.least(F.lit(0.6), base)), hits, n_terms)


def finalise_vectors(results: DataFrame, terms: DataFrame, k: int, content: str = "content") -> DataFrame:
    """PRJ6: near copies dropped, ranked anew, confidence by lexical coverage, source label. ``terms(query_id, terms)`` holds folded terms."""
    rows = drop_near_copies(results, k, content).join(terms, "query_id", "left")
    listed = F.coalesce("terms", X.no_strings())
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    confidence = lexical_confidence(base, term_hits(F.col(content), listed), F.size(listed))
    return rows.select("query_id", "chunk_id", "score", confidence.alias("score_normalized"), "rank", F.lit("vector").alias("source"))


# Sections of a graph result and how many of their lines a prompt keeps.
SECTION_CUT = "\\n\\s*\\n(?=(?:Graph paths:|Entities:|Evidence:))"
SECTION_LINES = {"Graph paths:": 5, "Entities:": 7}


def compress_graph_result(content: Column, most: int) -> Column:
    """A graph result shrunk to about ``most`` characters, whole sections first to last.

    Paths and entities keep a few lines, evidence half the budget; the first
    section always stays, cut at the budget, and the first one that would pass it
    ends the result.
    """

    def shorten(s: Column) -> Column:
        out = F.when(F.startswith(s, F.lit("Evidence:")), F.btrim(F.concat(F.lit("Evidence:\n"), F.left(F.btrim(F.substr(s, F.lit(10)), F.lit(" \t\n\r")), F.lit(most // 2))), F.lit(" \t\n\r")))
        for prefix, n in SECTION_LINES.items():
            out = out.when(F.startswith(s, F.lit(prefix)), F.btrim(F.array_join(F.slice(F.split(s, "\n"), 1, n), "\n"), F.lit(" \t\n\r")))
        return out.otherwise(s)

    text = F.btrim(X.text_or_empty(content), F.lit(" \t\n\r"))
    parts = F.filter(F.transform(F.split(text, SECTION_CUT), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        used = acc["used"] + F.length(s) + F.when(acc["text"] != "", 2).otherwise(0)
        stop = acc["done"] | ((acc["text"] != "") & (used > most))
        kept = F.btrim(F.left(s, F.lit(most)), F.lit(" \t\n\r"))
        grown = F.when(acc["text"] == "", kept).otherwise(F.concat(acc["text"], F.lit("\n\n"), kept))
        return F.struct(F.when(stop, acc["text"]).otherwise(grown).alias("text"), F.when(stop, acc["used"]).otherwise(used).alias("used"), (stop | (used >= most)).alias("done"))

    packed = F.aggregate(F.transform(parts, shorten), start, add, lambda acc: acc["text"])
    return F.when(F.length(text) <= most, text).when(F.size(parts) == 0, F.left(text, F.lit(most))).otherwise(packed)


def pack_sizes(sizes: Column, limit: int) -> Column:
    """The group number (from 0) of each piece: a piece that would pass ``limit`` begins a new group."""
    start = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).alias("now"), F.lit(0).cast("long").alias("used"))

    def add(acc: Column, n: Column) -> Column:
        fresh = (acc["used"] > 0) & (acc["used"] + n > limit)
        now = F.when(fresh, acc["now"] + 1).otherwise(acc["now"])
        return F.struct(F.concat(acc["groups"], F.array(now)).alias("groups"), now.alias("now"), F.when(fresh, n.cast("long")).otherwise(acc["used"] + n).alias("used"))

    return F.aggregate(sizes, start, add, lambda acc: acc["groups"])
