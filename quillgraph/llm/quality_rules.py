"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base figures of a text are counted inside its own row.  Four ratios follow as
whole numbers.  Their distribution per language and source is kept in mergeable
quantile sketches: a sketch is a histogram whose bins are exact below 128 and
then keep seven leading bits (relative error under 1/64), so sketches of parts
add up cell by cell, and those of sources merge into one per language and one
for everything.  A group with few rows uses the next wider sketch.

A ratio's bound is a high quantile of the group's sketch plus a multiple of its
distance from a lower one, so each language and source has bounds of its own: a
group whose texts are full of symbols or repeats allows more of them than one
that has none.  Which quantiles are read, and how far a bound lies beyond them,
is all that ``RATIOS`` fixes.  Counts scatter about their rate, so a text is out
of bounds if its count is above what the bound gives for its size by more than
three standard deviations of such a count and three more (what a count of mean
zero may show).  Word lengths are averages and have a bound on both sides.
The thresholds are joined back to the rows.

Edge cases: null and blank texts have no words and fail the base rules; null
languages and sources are groups of their own; a whole table below the group
minimum uses the overall sketch; texts of any length are read whole; repeated
rows count each; ties at a bound are inside; an empty table gives an empty
result; columns that are not kept are dropped, and kept columns with the name of
an output are replaced; :func:`filter_documents` keeps all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .tables import set_aside

BLANKS = " \t\n\x0b\f\r"
#: ratio -> (its count, its size, times, lower and upper percentile of the sketch, distances beyond the upper one, bounded below too)
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 1000, 50, 85, 3, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1000, 90, 99, 2, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 1000, 90, 99, 2, False),
    "word_length": ("word_chars", "n_words", 100, 25, 75, 5, True),
}
SPLITS = 16
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_ROWS = 100


def base_figures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with the base figures and n_lines (lines that hold a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    rows = docs.select(*keep, text.alias("__t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    grams = F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(1), F.size("__w") - 2), lambda i: F.xxhash64(F.element_at("__w", i), F.element_at("__w", i + 1), F.element_at("__w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        grams.alias("__g"),
    )
    rows = rows.withColumn("__twice", F.size("__g") > F.size(F.array_distinct("__g")))
    ordered = F.when(F.col("__twice"), F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("__s", ordered)
    nothing = F.array().cast("array<int>")
    equal = F.zip_with(F.slice("__s", F.lit(1), F.size("__s") - 1), F.slice("__s", F.lit(2), F.size("__s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(nothing))
    rows = rows.withColumn("__p", F.when(F.col("__twice"), F.sort_array(F.array_distinct(F.flatten(equal)))))
    steps = F.zip_with(F.slice("__p", F.lit(1), F.size("__p") - 1), F.slice("__p", F.lit(2), F.size("__p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    repeated = F.when(F.col("__twice"), F.aggregate(steps, F.lit(3).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def with_ratios(rows: DataFrame) -> DataFrame:
    def per(a: str, b: str, times: int) -> Column:
        return F.call_function("div", F.col(a) * times, F.greatest(F.col(b), F.lit(1).cast("long")))

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.select("*", failed.alias("base_failed"), *(per(count, size, times).alias(r) for r, (count, size, times, *_) in RATIOS.items()))


def sketch_bin(value: Column) -> Column:
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Sketch cells (groups, ratio, bin, n) of rows that pass the base rules: partial counts merge map-side."""
    pairs = F.array(*(F.struct(F.lit(r).alias("ratio"), sketch_bin(F.col(r)).alias("bin")) for r in RATIOS))
    return rows.where("not base_failed").select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.ratio", "x.bin").groupBy(*groups, "ratio", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(cells: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, level, lo_<ratio>, hi_<ratio>): bounds for every group, from the narrowest sketch with MIN_ROWS rows."""
    keys = cells.select(lang, source).distinct().select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"))
    merged = None
    for level, by in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        names = {"lang": lang, "source": source}
        part = cells.select(*((F.col(names[c]) if c in by else F.lit(None).cast("string")).alias(c) for c in names), "ratio", "bin", "n")
        part = part.groupBy("lang", "source", "ratio", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        merged = part if merged is None else merged.unionByName(part)
    group = Window.partitionBy("level", "lang", "source", "ratio")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(group)
    cum = merged.withColumn("upto", upto).withColumn("total", total)
    pick = lambda ratio, k: F.min(F.when((F.col("ratio") == ratio) & (F.col("upto") * 100 >= F.col("total") * RATIOS[ratio][k]), F.col("bin")))
    bounds = cum.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(pick(r, k).alias(f"{r}_{k}") for r in RATIOS for k in (3, 4)))
    reach = lambda r: (F.col(f"{r}_4") - F.col(f"{r}_3")) * RATIOS[r][5]
    bounds = bounds.select(
        "level", "lang", "source", "total",
        *((F.col(f"{r}_4") + reach(r)).alias(f"hi_{r}") for r in RATIOS),
        *((F.col(f"{r}_3") - reach(r)).alias(f"lo_{r}") for r in RATIOS if RATIOS[r][6]),
    )
    own = keys.join(bounds.where("level = 0").drop("level"), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("lang", "source").withColumn("level", F.lit(0))
    wide = keys.join(bounds.where("level = 1").drop("level"), F.col("lang").eqNullSafe(F.col("g_lang")), "left").drop("lang", "source").withColumn("level", F.lit(1))
    all_ = keys.join(bounds.where("level = 2").drop("level"), F.lit(True), "left").drop("lang", "source").withColumn("level", F.lit(2))
    options = own.unionByName(wide).unionByName(all_).where((F.col("total") >= MIN_ROWS) | (F.col("level") == 2))
    names = [c for c in options.columns if c not in ("g_lang", "g_source", "total")]
    best = options.groupBy("g_lang", "g_source").agg(F.min_by(F.struct(*names), "level").alias("b"))
    return best.select("g_lang", "g_source", "b.*")


def outside(ratio: str) -> Column:
    """Is a row beyond the bounds hi_<ratio> (and lo_<ratio>) that stand beside its figures?"""
    count, size, times, *_, low = RATIOS[ratio]
    if low:
        return (F.col(ratio) > F.col(f"hi_{ratio}")) | (F.col(ratio) < F.col(f"lo_{ratio}"))
    expected = F.col(f"hi_{ratio}") * F.col(size) / F.lit(float(times))
    return F.col(count) > expected + F.sqrt(expected) * 3 + 3


def judge(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_broadcast: int = 50_000) -> DataFrame:
    """Columns ``keep`` with base figures, ratios, base_failed and kept.

    The figures are written once as narrow rows; sketches and the joined filter
    read those.  Thresholds have a row per language and source; up to
    ``max_broadcast`` of them are broadcast, more are joined on language, source
    and one of ``SPLITS`` copies, so that a hot group is spread over tasks.
    """
    keep = [c for c in keep if c not in (*BASE, "n_lines", *RATIOS, "base_failed", "kept")]
    given = docs.select(*keep, F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    rows = materialize(with_ratios(base_figures(given, [*keep, "__lang", "__source"], "__text")), "quality-figures")
    bounds = materialize(thresholds(sketches(rows, ["__lang", "__source"]), "__lang", "__source"), "quality-bounds").drop("level")
    same = F.col("__lang").eqNullSafe(F.col("g_lang")) & F.col("__source").eqNullSafe(F.col("g_source"))
    if bounds.count() <= max_broadcast:
        joined = rows.join(F.broadcast(bounds), same, "left")
    else:
        copies = bounds.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        split = rows.withColumn("__split", F.pmod(F.xxhash64(*BASE, F.monotonically_increasing_id()), F.lit(SPLITS)).cast("int"))
        joined = split.join(copies, same & (F.col("__split") == F.col("__copy")), "left")
    bad = F.lit(False)
    for r in RATIOS:
        bad = bad | F.coalesce(outside(r), F.lit(False))
    return joined.select(*keep, *BASE, *RATIOS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without rejected rows."""
    given, names = set_aside(docs)
    judged = judge(given, list(names.values()), names[text_col], names[lang_col], names[source_col])
    return judged.where("kept").select(*names.values()).toDF(*docs.columns)
