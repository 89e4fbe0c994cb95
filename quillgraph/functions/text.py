"""Text expressions: terms, signatures, information scores, sentence splits, facts. All stay in the JVM.

Lengths are code points, case folding is ``lower`` plus ß to ss, regular
expressions are Java's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
LATIN_TERM = "[A-Za-z0-9][A-Za-z0-9_-]+"
EMPTY = "array<string>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where the plain expression would repeat it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold(text: Column) -> Column:
    """Case folding."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def squeeze(text: Column) -> Column:
    """Trimmed, runs of blanks as one space."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def no_strings() -> Column:
    return F.array().cast(EMPTY)


def latin_tokens(text: Column) -> Column:
    """Folded Latin tokens of two characters or more, repeats included; they are ASCII, so folding is ``lower``."""
    return F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(LATIN_TERM), F.lit(0)), lambda t: F.lower(t))


def latin_terms(text: Column) -> Column:
    """K1, Latin part: distinct folded tokens of two characters or more, in order of appearance."""
    return F.array_distinct(latin_tokens(text))


def cjk_terms(text: Column, longest: int = 8) -> Column:
    """K1, CJK part: distinct n-grams of 2..longest characters, shorter first, repeats of one character left out."""
    segments = F.regexp_extract_all(text_or_empty(text), F.lit(f"[{CJK}]{{2,}}"), F.lit(0))

    def grams(seg: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(longest), F.length(seg)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(seg) - n + 1), lambda i: F.substr(seg, i, n))))

    every = F.flatten(F.transform(segments, grams))
    return F.array_distinct(F.filter(every, lambda g: F.size(F.array_distinct(F.split(g, ""))) > 1))


def terms(text: Column, longest: int = 8) -> Column:
    """K1: Latin tokens, then CJK n-grams, ordered and distinct."""
    return F.array_distinct(F.concat(latin_terms(text), cjk_terms(text, longest)))


def length_boost(term: Column) -> Column:
    return F.lit(1.0) + F.least(F.length(term), F.lit(8)) / F.lit(8.0)


def name_normal(text: Column) -> Column:
    """K3: trimmed, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "\\s+", " "))


#: Blanks and marks that no signature holds.
ASCII_MARKS = "\t\n\r" + "".join(c for c in map(chr, range(32, 127)) if not c.isalnum())


def alias_signature(text: Column) -> Column:
    """K3: folded letters and digits only."""
    # most of what goes is blanks and ASCII marks; a plain replacement is several times faster than a match for each
    # (and the look ahead is several times faster than one negated class of all ranges)
    return F.regexp_replace(F.translate(fold(text), ASCII_MARKS, ""), f"(?![0-9a-z])[^{CJK}]", "")


def abbreviation(text: Column) -> Column:
    """K3: folded initials of two words or more, else empty."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.when(F.size(words) < 2, "").otherwise(fold(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")))


# What stands around a phrase without belonging to it.
EDGE_PUNCTUATION = " ,.;:()[]{}，。；：、"
LIST_MARKS = "*•—–>-"
LEADING_PARTICLES = "和与及或在对为是应需"
TRAILING_PARTICLES = "的时后前中者"


def without_edges(text: Column, particles: bool = False) -> Column:
    """F7, FLT6: a phrase with single spaces and nothing around it: one anchored pattern for each side.

    Behind the phrase go list marks and an arrow before them, before it list marks
    and then an arrow; with
    ``particles`` also one trailing and any leading particles, inside the marks.
    """
    behind = f"(?:(?:\\s*(?:--+|[-=]+>)(?=\\s))?\\s*[{LIST_MARKS}]+)?$"
    before = f"^(?:[{LIST_MARKS}]+\\s*)?(?:=[-=]*>\\s*)?"
    if particles:
        behind, before = f"[{TRAILING_PARTICLES}]?{behind}", f"{before}[{LEADING_PARTICLES}]*"
    inner = F.btrim(F.regexp_replace(text, "\\s+", " "), F.lit(EDGE_PUNCTUATION))
    return F.btrim(F.regexp_replace(F.regexp_replace(inner, behind, ""), before, ""), F.lit(EDGE_PUNCTUATION))


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def abbreviation_alias(alias: Column, name: Column) -> Column:
    """K4: the alias is the name's initials."""
    return F.trim(alias).rlike("^[A-Za-z0-9]{2,10}$") & (abbreviation(name) != "") & (fold(F.trim(alias)) == abbreviation(name))


def cross_language_alias(alias: Column, name: Column) -> Column:
    """K4: one side is CJK only and the other Latin only, and it is no abbreviation."""
    return ~abbreviation_alias(alias, name) & (has_cjk(alias) != has_cjk(name)) & (has_latin(alias) != has_latin(name))


def surface_forms(name: Column, aliases: Column) -> Column:
    """K5: the name, its aliases of the same script, and their signatures; two characters or more, distinct ignoring case."""
    values = F.concat(F.array(name), F.filter(aliases, lambda a: ~cross_language_alias(a, name)))
    both = F.filter(F.flatten(F.transform(values, lambda v: F.array(F.trim(v), alias_signature(v)))), lambda v: F.length(v) >= 2)
    return F.aggregate(both, no_strings(), lambda acc, v: F.when(F.exists(acc, lambda a: fold(a) == fold(v)), acc).otherwise(F.concat(acc, F.array(v))))


def token_signatures(text: Column) -> Column:
    """folded tokens of two characters or more and their signatures."""
    found = F.filter(F.regexp_extract_all(text_or_empty(text), F.lit("[\\u4e00-\\u9fff]+|[A-Za-z0-9][A-Za-z0-9_-]*"), F.lit(0)), lambda t: F.length(t) >= 2)
    # such tokens hold letters, digits, dashes and underscores only, so folding is ``lower`` and a signature drops the marks
    tokens = F.array_distinct(F.transform(found, lambda t: F.lower(t)))
    return F.array_distinct(F.filter(F.concat(tokens, F.transform(tokens, lambda t: F.translate(t, "-_", ""))), lambda t: t != ""))


def has_token_signature(text: Column, signature: Column) -> Column:
    """Whether :func:`token_signatures` of ``text`` hold an ASCII ``signature`` of letters and digits, two at least; no token is listed."""
    marked = F.regexp_replace(signature, "(.)", "$1[-_]*+")
    return F.rlike(text, F.concat(F.lit("(?i)(?<![0-9A-Za-z_-])[-_]*+"), marked, F.lit("(?![0-9A-Za-z_-])")))


def quoted(text: Column) -> Column:
    """A column's value as a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def whole_word_count(text: Column, form: Column) -> Column:
    pattern = F.concat(F.lit("(?i)(?<![0-9A-Za-z_])"), quoted(form), F.lit("(?![0-9A-Za-z_])"))
    return F.regexp_count(text, pattern)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return F.call_function("div", F.length(text) - F.length(F.replace(text, part, F.lit(""))), F.greatest(F.length(part), F.lit(1)))


def mention_score(text: Column, forms: Column) -> Column:
    """F1 without its fuzzy rule: best score over forms, the first rule that fires per form."""
    return F.coalesce(F.array_max(F.transform(mention_scores(text, forms), lambda s: s["score"])), F.lit(0.0))


def mention_scores(text: Column, forms: Column, given: Column | None = None) -> Column:
    """F1 for each form: array of (form, score); the text is folded once, or ``given`` as :func:`mention_given` has it."""

    def best(given: Column) -> Column:
        low, plain = given["low"], given["plain"]

        def one(form: Column) -> Column:
            f = F.trim(form)
            n = F.length(f)
            sig, abbr = alias_signature(f), abbreviation(f)
            cjk = F.least(occurrences(low, fold(f)), F.lit(3)) * F.greatest(F.lit(1.0), n / 4.0)
            # a form that isn't in the folded text at all can't stand in it as a whole word
            words = F.when(F.contains(low, fold(f)), whole_word_count(text, f)).otherwise(0)
            latin = let(
                words,
                lambda w: F.when(w > 0, F.least(w, F.lit(3)) * F.greatest(F.lit(1.0), n / 5.0))
                .when((n > 4) & F.contains(low, F.lower(f)), F.greatest(F.lit(0.5), n / 12.0))
                .when((F.length(sig) >= 5) & F.contains(plain, sig), F.greatest(F.lit(0.8), F.length(sig) / 10.0))
                .when((abbr != "") & has_token_signature(text, abbr), F.lit(0.95))
                .otherwise(F.lit(0.0)),
            )
            return F.when(n == 0, F.lit(0.0)).when(has_cjk(f), cjk).otherwise(latin)

        return F.transform(forms, lambda f: F.struct(f.alias("form"), one(f).cast("double").alias("score")))

    return let(mention_given(text), best) if given is None else best(given)


def mention_given(text: Column) -> Column:
    """What F1 needs of a text: its folded form and its signature."""
    return F.struct(fold(text).alias("low"), alias_signature(text).alias("plain"))


def contains_surface(text: Column, surface: Column) -> Column:
    """FLT9."""
    return F.when(has_cjk(surface), F.contains(text, surface)).otherwise(whole_word_count(text, surface) > 0)


SENTENCE_CUTS = {
    "graph": "(?<=[。！？!?；;])\\s*|\\n+",
    "assertion": "(?<=[。！？!?；;])\\s*|\\n+",
    "evidence": "(?<=[。！？!?；;\\n])\\s*",
    "generator": "(?<=[。！？.!?；;])\\s*|\\n+",
    "loader": "(?<=[.!?。！？])\\s+",
}


def sentences(text: Column, style: str = "generator") -> Column:
    """F8: trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text_or_empty(text), SENTENCE_CUTS[style]), lambda s: F.trim(s)), lambda s: s != "")


def stop_word_ratio(text: Column, stop_words: tuple[str, ...] = L.STOP_WORDS) -> Column:
    found = F.regexp_extract_all(fold(text), F.lit("[A-Za-z]+"), F.lit(0))
    return let(found, lambda tokens: F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda t: t.isin(*stop_words))) / F.size(tokens)))


def information_score(text: Column) -> Column:
    """FLT2: one point for each of five shape tests; empty texts have none."""
    point = lambda test: F.when(test, 1.0).otherwise(0.0)

    def score(chars: Column) -> Column:
        n = F.length(chars)
        unique = F.size(F.array_distinct(F.split(chars, "")))
        punctuation = n - F.length(F.regexp_replace(chars, "[^\\p{L}\\p{M}\\p{N}_]+", ""))
        alnum = F.length(F.regexp_replace(chars, "[^\\p{L}\\p{N}]+", ""))
        points = point(n >= 24) + point(unique / n >= 0.35) + point(stop_word_ratio(text_or_empty(text)) <= 0.65) + point(punctuation / n <= 0.55) + point(alnum / n >= 0.35)
        return F.when(n == 0, 0.0).otherwise(points)

    return let(F.regexp_replace(text_or_empty(text), "\\s+", ""), score)


# Fixed values.
FACT_SHAPES = (
    "[A-Za-z][A-Za-z0-9/+.-]*\\s*(?:<|>|<=|>=|≤|≥|=)\\s*\\d",
    "\\d+(?:\\.\\d+)?\\s*(?:μg|ug|mg|g|ml|mL|%|次|/μL|/uL|mL/min|ml/min)",
    "(?:每日|每天|每周)\\s*\\d+\\s*次",
)


def strong_fact_shape(text: Column) -> Column:
    """FLT3."""
    t = text_or_empty(text)
    return t.rlike(FACT_SHAPES[0]) | t.rlike(FACT_SHAPES[1]) | t.rlike(FACT_SHAPES[2])


def hard_normal(text: Column) -> Column:
    """F19's normaliser: folded, full-width marks made plain, no blanks."""
    t = F.translate(fold(text_or_empty(text)), "（），％–—－", "(),%---")
    return F.regexp_replace(F.replace(F.replace(t, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">=")), "\\s+", "")


NUMBER = "(?:\\d+(?:\\.\\d+)?|[一二两三四五六七八九十])"


def canonical_number(value: Column) -> Column:
    digits = F.translate(value, "一二两三四五六七八九", "122345678" + "9")
    digits = F.when(value == "十", "10").otherwise(digits)
    return F.when(F.contains(digits, F.lit(".")), F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "\\.$", "")).otherwise(digits)


def quantitative_facts(text: Column) -> Column:
    """sorted distinct keys kind:value[:unit][:operator]."""
    t = hard_normal(text)

    def keys(pattern: str, group: int, make) -> Column:
        found = F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v: v != "")
        return F.transform(found, make)

    per_day = [keys(f"(?:每日|每天|每)({NUMBER})次", 1, lambda v: F.concat(F.lit("frequency:"), canonical_number(v), F.lit(":day"))), keys(f"({NUMBER})次/(?:日|天|day|d)", 1, lambda v: F.concat(F.lit("frequency:"), canonical_number(v), F.lit(":day")))]
    per_week = [keys(f"(?:每周|每星期|每礼拜|每)({NUMBER})次", 1, lambda v: F.concat(F.lit("frequency:"), canonical_number(v), F.lit(":week"))), keys(f"({NUMBER})次/(?:周|星期|礼拜|week|w)", 1, lambda v: F.concat(F.lit("frequency:"), canonical_number(v), F.lit(":week")))]
    compared = F.transform(
        F.regexp_extract_all(t, F.lit("(<=|>=|<|>|=)(\\d+(?:\\.\\d+)?)"), F.lit(0)),
        lambda m: F.concat(F.lit("comparison:"), canonical_number(F.regexp_replace(m, "^[<>=]+", "")), F.lit(":"), F.regexp_extract(m, "^[<>=]+", 0)),
    )
    amount = "(\\d+(?:\\.\\d+)?)(%|mg|ml|mmol|μg|ug|pg|g/l|iu|分钟|小时|个月|天|年)"
    amounts = F.transform(
        F.regexp_extract_all(t, F.lit(amount), F.lit(0)),
        lambda m: F.concat(F.lit("quantity:"), canonical_number(F.regexp_extract(m, "^[0-9.]+", 0)), F.lit(":"), F.regexp_replace(F.regexp_replace(m, "^[0-9.]+", ""), "^ug$", "μg")),
    )
    return F.array_sort(F.array_distinct(F.concat(*per_day, *per_week, compared, amounts)))


def conflicting_facts(claim: Column, evidence: Column) -> Column:
    """some evidence fact of a claim fact's kind has another value or unit."""
    kind = lambda k: F.substring_index(k, ":", 1)
    return F.exists(claim, lambda c: F.exists(evidence, lambda e: (kind(e) == kind(c)) & (e != c)))


def sanitize_lucene(text: Column) -> Column:
    """query-syntax characters become blanks, runs of blanks one."""
    return squeeze(F.regexp_replace(text, "[+\\-!(){}\\[\\]^\"~*?:\\\\/&|]", " "))


def entity_estimate(text: Column) -> Column:
    """distinct capitalised tokens."""
    return F.size(F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit("\\b[A-Z][A-Za-z0-9-]{2,}"), F.lit(0))))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters every ``size - overlap``."""
    t = text_or_empty(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(t == "", no_strings()).otherwise(F.transform(starts, lambda i: F.substr(t, i + 1, F.lit(size))))
