"""Datasets and evaluation runs: converters, gold review, judges' answers, modes, resuming, traces, synthetic samples (X15, X18-X25, X27, ST2)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LABELS = ("affirmed", "negated", "speculated", "conditional", "historical", "family_history")


def run_modes(queries: DataFrame, modes: Mapping[str, Callable[[DataFrame], DataFrame]], enabled: Sequence[str] | None = None) -> DataFrame:
    """The union of all modes' answers with a column mode; unknown names in ``enabled`` are errors."""
    chosen = list(modes) if enabled is None else list(enabled)
    if unknown := [m for m in chosen if m not in modes]:
        raise ValueError(f"unknown modes: {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, (modes[m](queries).withColumn("mode", F.lit(m)) for m in chosen))


def unfinished(work: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``work`` whose keys are not among the finished ones; null keys count as keys."""
    done = finished.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return work.join(done, same, "left_anti")


def kind_counts(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kinds): how often each kind occurs, as a map; counted before it is collected, so a map has a row per kind."""
    counts = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(kind, F.lit("none")).alias("k"), "n")))).alias("kinds"))


def compile_gold(reviews: DataFrame) -> DataFrame:
    """Gold rows of reviews(id, text, entity, start, end, gold_label, weak_label, source).

    Rows without a gold label are left out; an unknown label or offsets that don't
    give the entity raise an error; missing offsets are looked up.
    """
    found = F.call_function("position", F.col("entity"), F.col("text")) - 1
    start = F.coalesce(F.col("start"), F.when(found >= 0, found)).cast("long")
    rows = reviews.withColumn("label", F.trim(X.text_or_empty(F.col("gold_label")))).where("label <> ''")
    rows = rows.withColumn("start", start).withColumn("end", F.coalesce(F.col("end"), F.col("start") + F.length("entity")).cast("long"))
    told = F.expr("substr(text, int(start) + 1, int(end - start))")
    good = F.col("label").isin(*LABELS) & F.col("start").isNotNull() & (F.col("end") > F.col("start")) & (told == F.col("entity"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("bad gold row "), F.col("id").cast("string"))))
    changed = (X.text_or_empty(F.col("weak_label")) != "") & (F.col("weak_label") != F.col("label"))
    return rows.select("id", "text", "entity", checked.alias("label"), "start", "end", F.concat_ws(":", F.lit("gold_review"), F.col("id").cast("string"), F.coalesce("source", F.lit(""))).alias("source"), changed.alias("weak_label_changed"))


def spans_of_records(records: DataFrame) -> DataFrame:
    """(id, text, entity, start, end) of records with an entity list, a subject/object list, or a mention alone.

    ``records(id, text, entities, spo)``: entities are (entity, start_idx, end_idx)
    with an inclusive end, whose surface is cut out where it is missing; subjects
    and objects are looked up in the text.  A record with neither list is one
    mention.  Rows of equal text, entity and place are one.
    """
    text = F.trim(X.text_or_empty(F.col("text")))
    rows = records.withColumn("text", text).where("text <> ''")
    cut = lambda e: F.when((F.trim(X.text_or_empty(e["entity"])) == "") & (e["start_idx"] >= 0) & (e["end_idx"] >= e["start_idx"]), F.substr(F.col("text"), e["start_idx"] + 1, e["end_idx"] - e["start_idx"] + 1)).otherwise(F.trim(X.text_or_empty(e["entity"])))
    listed = F.transform("entities", lambda e: F.struct(cut(e).alias("entity"), e["start_idx"].cast("long").alias("start"), (e["end_idx"] + 1).cast("long").alias("end")))

    def looked_up(name: Column) -> Column:
        at = F.call_function("position", name, F.col("text")).cast("long")
        return F.struct(name.alias("entity"), (at - 1).alias("start"), (at - 1 + F.length(name)).cast("long").alias("end"))

    named = F.transform(F.flatten(F.transform("spo", lambda s: F.array(F.trim(X.text_or_empty(s["subject"])), F.trim(X.text_or_empty(s["object"]))))), looked_up)
    whole = F.array(F.struct(F.col("text").alias("entity"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")))
    spans = F.when(F.size(F.coalesce("entities", F.array())) > 0, listed).when(F.size(F.coalesce("spo", F.array())) > 0, named).otherwise(whole)
    each = rows.select("id", "text", F.inline(spans)).where("entity <> '' and start >= 0 and end <= length(text)")
    return each.groupBy("text", "entity", "start", "end").agg(F.min("id").alias("id")).select("id", "text", "entity", "start", "end")


def prepared_questions(questions: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """questions(id, question, question_type, answer) trimmed, without blank ones, types by ``types`` (lower case, else "unknown"), the first of each (id, question)."""
    kind = F.lower(F.trim(X.text_or_empty(F.col("question_type"))))
    if types:
        kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in types.items() for x in pair)), kind), kind)
    rows = questions.select("id", F.trim(X.text_or_empty(F.col("question"))).alias("question"), F.when(kind == "", "unknown").otherwise(kind).alias("type"), F.trim(X.text_or_empty(F.col("answer"))).alias("reference_answer"))
    rows = rows.where("question <> ''")
    return rows.groupBy("id", "question").agg(F.min_by(F.struct("type", "reference_answer"), F.struct("type", "reference_answer")).alias("v")).select("id", "question", "v.*")


def plain_lines(markdown: Column) -> Column:
    """A Markdown text's lines without heading marks, list items behind a bullet."""
    lines = F.transform(F.split(X.text_or_empty(markdown), "\n"), lambda x: F.rtrim(x))
    item = lambda x: F.concat(F.lit("• "), F.trim(F.substr(F.ltrim(x), F.lit(3))))
    return F.transform(lines, lambda x: F.when(F.trim(x) == "", "").when(F.startswith(F.ltrim(x), F.lit("#")), F.trim(F.regexp_replace(x, "^#+", ""))).when(F.startswith(F.ltrim(x), F.lit("- ")), item(x)).otherwise(x))


def rating(answer: Column) -> Column:
    """A judge's rating 0, 1 or 2 from JSON ("rating" or "score", or a list of one) or free text; null if there is none."""
    number = lambda t: F.when(t.try_cast("double").isin(0.0, 1.0, 2.0), t.try_cast("double"))
    field = F.coalesce(number(F.get_json_object(answer, "$.rating")), F.when(F.get_json_object(answer, "$.rating").isNull(), number(F.get_json_object(answer, "$.score"))))
    single = F.when(answer.rlike("^\\s*\\["), number(F.regexp_extract(answer, "^\\s*\\[\\s*([0-9.]+)\\s*\\]\\s*$", 1)))
    words = F.transform(F.split(F.trim(F.translate(answer, "{}", "  ")), "\\s+"), lambda w: number(F.btrim(w, F.lit("\",:"))))
    free = F.when(~answer.rlike("^\\s*\\["), F.try_element_at(F.filter(words, lambda w: w.isNotNull()), F.lit(1)))
    return F.coalesce(field, single, free)


def relevance_of(one: Column, two: Column) -> Column:
    """The mean of two ratings on a scale to 1; one missing rating leaves the other, two give null."""
    n = one.isNotNull().cast("int") + two.isNotNull().cast("int")
    return F.when(n > 0, (F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0))) / n / 2.0)


def attributed_share(answer: Column) -> Column:
    """Share of valid statements that a judge attributes, from a JSON list of (statement, attributed); null without valid ones."""
    items = F.from_json(answer, "array<struct<statement:string,attributed:string>>")
    valid = F.filter(items, lambda i: i["statement"].isNotNull() & i["attributed"].try_cast("int").isin(0, 1))
    ones = F.filter(valid, lambda i: i["attributed"].try_cast("int") == 1)
    return F.when(F.size(valid) > 0, F.size(ones) / F.size(valid))


def report(rows: DataFrame, mode: str, correct: Column, retries: str) -> DataFrame:
    """One row per mode with its report lines."""
    stats = rows.groupBy(mode).agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.avg(retries).alias("retries"))
    text = F.concat(F.lit("### "), F.col(mode), F.format_string("\n  accuracy: %.2f%% (%d/%d)\n  mean retries: %.2f", F.round(F.col("correct") * 100.0 / F.col("total"), 2), F.col("correct"), F.col("total"), F.round("retries", 2)))
    return stats.select(mode, text.alias("report"))


def sse_frame(event: Column, data: Column) -> Column:
    """A server-sent event; line breaks of the data become data lines."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.regexp_replace(data, "\n", "\ndata: "), F.lit("\n\n"))


def stream_pieces(text: Column, size: int) -> Column:
    """ST2: an answer as the pieces a stream would send, ``size`` characters each."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(X.no_strings())


def synthetic_samples(templates: DataFrame, slots: DataFrame) -> DataFrame:
    """(label, text, entity, start, end): templates(label, template) with {entity} filled by slots(entity).

    Both tables are small word lists; each template meets the slots by a broadcast.
    """
    rows = slots.select("entity").distinct().join(F.broadcast(templates), F.lit(True))
    at = F.instr("template", "{entity}")
    text = F.replace(F.col("template"), F.lit("{entity}"), F.col("entity"))
    return rows.where(at > 0).select("label", text.alias("text"), "entity", (at - 1).cast("long").alias("start"), (at - 1 + F.length("entity")).cast("long").alias("end"))
