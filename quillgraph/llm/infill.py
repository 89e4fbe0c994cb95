"""Fill-in-middle examples: a constant-memory two-pass streaming matcher.

A text is matched left to right by ``UNIT``.  The first pass only counts the
units; the second advances a lazy match iterator to the two drawn ranks and
notes where they end.  No list of units is ever stored, so beside the text
itself a worker's memory does not grow with the text.

The ranks, the form and the order of the parts are drawn from the sha256 of
``seed:id``, so reruns and retries agree and no row depends on another.

Edge cases: null and empty texts are plain, with an empty output; a text that
holds one of the markers is plain, so every other output holds each marker
exactly once where it was put and :func:`restored` is exact; parts may be empty;
a null id is drawn like the empty string; rows with equal ids draw the same
numbers; texts of any length are read whole; an empty table gives an empty
result; kept columns with the name of an output are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import pieces

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]


def count_units(text: str) -> int:
    """First pass: the number of units."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends_of(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the code points that the first ``low`` and the first ``high`` units span, low <= high."""
    units = UNIT.finditer(text)
    to_low = next(islice(units, low - 1, None)).end() if low else 0
    return to_low, next(islice(units, high - low - 1, None)).end() if high > low else to_low


def split(text: str, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle code points, output) of one text."""
    n = count_units(text)
    if not text or draws[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    ranks = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = ends_of(text, *ranks)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def draws_of(id_col: str, seed: int) -> list[Column]:
    """The first four groups of eight digits of the id's sha256, as whole numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "doc_id", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """Columns ``keep`` with n, form, prefix_chars, middle_chars and output, one row per row of ``docs``.

    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these with the suffix first.
    """
    keep = [c for c in keep if c not in MADE]
    schema = docs.select(*keep).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            inputs = [batch.column(len(keep) + i).to_pylist() for i in range(5)]
            rows = [split(text or "", tuple(draws), rate, spm_rate) for text, *draws in zip(*inputs, strict=True)]
            made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            made[4] = made[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, *MADE])

    drawn = [d.alias(f"__draw{i}") for i, d in enumerate(draws_of(id_col, seed))]
    return docs.select(*keep, F.col(text_col).alias("__read_text"), *drawn).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone; every marker stands once in it."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(examples: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
