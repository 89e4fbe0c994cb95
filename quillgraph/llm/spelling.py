"""Spelling variants: the symmetric-delete join.

Words are counted in whole texts; a word of ``MIN_LENGTH`` letters or more that
occurs ``min_count`` times or more takes part.  Every word emits itself and its
distinct single deletions as keys; words that share a key are candidates, and an
exact edit distance of one confirms them.  Two words at distance one always
share a key: the shorter word itself, or what both leave at the replaced letter.
A word's form is the most frequent near word that is ``ratio`` times as
frequent or more, and roots follow forms by repeated joins of the table with itself.

Scale: a task adds up its counts before anything is shuffled, so a frequent word
is one row a task.  Keys are 64-bit hashes, rolled over the word, so a word of n
letters gives n + 1 keys of eight bytes and not n strings of n letters; words are
fetched again for the verification, and a hash that two keys share costs a
comparison, never a result.  A key's group is bounded by the alphabet (91
letters for each place of the key), not by the data.  A form is ``ratio`` times
as frequent, so a chain of forms has at most log(n) / log(ratio) words, and the
joins double the distance.

Edge cases: null, empty and letterless texts have no words; a null id marks its
runs as the empty string; repeated rows count again; words of any length take
part; ties of n go to the smallest word in code-point order; other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Every run whose hash this number divides loses one letter.
TYPO_EVERY = 199
#: Distinct words that a task adds up before it hands them on.
HELD = 200_000
#: Base of the rolling hash, an odd number; arithmetic is modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def misspelt(doc_id: str, run: str) -> str:
    """``run`` without one letter if the hash of its document and itself says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): the words that take part with their number of occurrences over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                doc_id = batch.column(0)[i].as_py()
                lowered = text.encode().lower().decode()  # bytes lower A-Z only
                for word, n in Counter(m[0] for m in RUN.finditer(lowered)).items():
                    if len(word) >= min_length and len(word := misspelt(doc_id, word)) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(word: str) -> np.ndarray:
    """Distinct hashes of ``word`` and of the word without each letter."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = len(letters)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, BASE, np.uint64), dtype=np.uint64)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * powers[1:], dtype=np.uint64)])
        # letters behind the deleted one move one place to the front; to need no division, the letters before it are multiplied instead
        shortened = sums[:-1] * np.uint64(BASE) + (sums[-1] - sums[1:])
        whole = sums[-1] * np.uint64(BASE)
        mixed = np.append(shortened, whole) ^ (np.append(np.full(size, size - 1), size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(mixed).view(np.int64)


def keys(words: DataFrame) -> DataFrame:
    """(key, id): the keys that every word emits; id is a 64-bit hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [deletion_keys(w) for w in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(ids)], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): words of ``words(id, word, n)`` at an edit distance of exactly one, both ways round."""
    keyed = keys(words)
    met = keyed.select("key", F.col("id").alias("i")).join(keyed.select("key", F.col("id").alias("j")), "key").where("i < j").select("i", "j").distinct()
    side = lambda c, name, n: words.select(F.col("id").alias(c), F.col("word").alias(name), F.col("n").alias(n))
    pairs = met.join(side("i", "a", "n_a"), "i").join(side("j", "b", "n_b"), "j")
    one = F.levenshtein("a", "b", 1) == 1
    near = pairs.where(one).select("a", "b", "n_a", "n_b")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word of ``words(id, word, n)``."""
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("n_b").alias("form_n")), F.struct(-F.col("n_b"), F.col("b")))
    found = near_pairs(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.select("word", "n").join(found.withColumnRenamed("a", "word"), "word", "left")
    held = F.col("best.form_n") >= ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("best.form")).alias("form"), F.when(held, F.col("best.form_n")).alias("form_n"))


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) for every word of ``rows(word, form)`` that has a form: the end of its chain of forms."""
    links = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        discard(rows.sparkSession, links)
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word that takes part."""
    words = materialize(count_words(docs, min_length, min_count, text_col, id_col).select(F.xxhash64("word").alias("id"), "word", "n"), "spelling-words")
    found = materialize(forms(words, ratio), "spelling-forms")
    rows = found.join(roots(found), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
