"""The exact half of near-duplicate removal: true shingle similarity by a prefix-filter join.

Words: A-Z lower-cased, split at blanks.  A text's set holds the hashes of its
``width``-word shingles (of the whole word sequence if it has fewer words).
Texts link at a Jaccard similarity of ``similarity`` or more; classes are the
connected components of links.

Search.  Equal word sequences collapse first.  SimHash fingerprints of the same
shingles meet through the pivot tables of :mod:`simhash`, and the pairs that
these give are confirmed on the sets.  Texts at the similarity's edge differ in
more bits than such a search can reach, so the rest is found by prefixes: in any
one order of all shingles, two sets of similarity t share one of their first
n - ceil(t n) + 1 shingles (n: the set's size), so only these prefixes meet, in
cells of equal shingles, and only pairs that are still in different classes are
looked at.  Shingles that are frequent in a sample come last in the order, which
keeps cells small; the sample changes the work, never the result.

Sizes, positions and a parity sketch discard pairs that can't reach t: bit b of
a sketch is the parity of the shingles that hash to b, so two sketches differ in
at most as many bits as the sets differ in shingles.  Every pair left is
confirmed on its sets.

A cell of up to ``SMALL`` rows gives all its pairs.  A larger one gives a star
at first, confirmed like the rest.  Then only its pairs that are still in
different classes are looked at, inside tasks of two slices of ``SLICE`` rows,
which give back only what sizes, places and sketches allow: for ``ROUNDS`` rounds
each row's nearest partner, at last everything left.  So a large group of copies
costs a few confirmations a row and no pair is left out.

Edge cases: null, empty and blank texts are copies of each other; rows without a
doc_id take part like others and come last when a class's row is chosen; of rows
with equal doc_ids each is judged by its own text, and of equal rows one stays;
ids may be strings; texts of any length are read whole; an empty table gives an
empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize
from ..operators.components import components
from .simhash import LOWER, by_task, representatives, similar_edges
from .tables import pieces, set_aside, with_places

SMALL, SLICE, ROUNDS, SAMPLE, MAX_FREQUENT, MAX_WORDS = 64, 2048, 2, 4000, 50_000, 100_000
PAIRS = "a long, b long"


def words_of(text: bytes | None) -> list[bytes]:
    return [w for w in text.translate(LOWER).split(b" ") if w] if text else []


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes, made of the words' hashes."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}
        self.factors = np.array([xxhash.xxh64_intdigest(b"place", i) | 1 for i in range(width)], np.uint64)

    def word(self, w: bytes) -> int:
        if (h := self.seen.get(w)) is None:
            if len(self.seen) >= MAX_WORDS:
                self.seen.clear()
            h = self.seen[w] = xxhash.xxh64_intdigest(w, 42)
        return h

    def hashes_of(self, words: list[bytes]) -> np.ndarray:
        """Hashes of all shingles in text order, repeats included."""
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.word, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out += hashes[k : k + n] * self.factors[k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))

    def set_of(self, words: list[bytes]) -> np.ndarray:
        return np.unique(self.hashes_of(words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: the bits that over half of them have, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        counts += np.unpackbits(hashes[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


#: Multipliers under which the least hash of a set is looked for.
MARKS = np.array([xxhash.xxh64_intdigest(b"mark", i) | 1 for i in range(3)], np.uint64)


def least_marks(hashes: np.ndarray) -> list[int]:
    """The least hash of a set under a few orders: similar sets mostly share one."""
    return [int((hashes * m).min().view(np.int64)) for m in MARKS] if len(hashes) else []


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bit b is the parity of the number of hashes with remainder b; some two to four bits a hash, a power of two."""
    bits = 1 << max(6, (2 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """A lower bound of the number of shingles in just one of two sets, from their parity sketches."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def frequent(docs: DataFrame, width: int, text_col: str) -> list[int]:
    """Shingles of three or more texts of a sample of about ``SAMPLE`` rows, rarest first."""
    share = SAMPLE / max(1, docs.count())
    some = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("__file", "__at"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in pieces(batches):
            sets = [shingler.set_of(words_of(t)) for t in _texts(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    counts = some.select(text_col).mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return [r.token for r in reversed(counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).collect())]


def prints(docs: DataFrame, width: int, similarity: float, text_col: str, id_col: str, last: list[int]) -> DataFrame:
    """(__file, __at, doc_id, hi, lo, fp, marks, n, sketch, prefix, __row): hi and lo name the word sequence; __row numbers the written rows."""
    tokens = np.array(last, np.int64).view(np.uint64)
    by_value = np.argsort(tokens)
    rows = docs.select("__file", "__at", F.col(id_col).alias("doc_id"), F.col(text_col).alias("__read_text"))
    schema = rows.drop("__read_text").schema.add("hi", "long").add("lo", "long").add("fp", "long").add("marks", T.ArrayType(T.LongType())).add("n", "integer").add("sketch", "binary").add("prefix", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(width), tokens[by_value]
        for batch in pieces(batches):
            digests, fps, marks, sizes, sketches, prefixes = [], [], [], [], [], []
            for text in _texts(batch, 3):
                words = words_of(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                every = shingler.hashes_of(words)
                fps.append(fingerprint_of(every))
                hashes = np.unique(every)
                marks.append(least_marks(hashes))
                sizes.append(len(hashes))
                sketches.append(parity_sketch(hashes))
                place = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    place = np.where(known[at] == hashes, by_value[at] + 1, 0)
                order = np.argsort(place, kind="stable")[: prefix_length(len(hashes), similarity)]
                prefixes.append(hashes[order].view(np.int64))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes or [np.zeros(0, np.int64)])))
            made = [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(fps, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id())


class Confirm:
    """Checks pairs of rows on their parity sketches, then on their shingle sets."""

    def __init__(self, docs: DataFrame, found: DataFrame, width: int, similarity: float, text_col: str):
        self.docs, self.found, self.width, self.similarity, self.text_col = docs, found, width, similarity, text_col

    def close(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(a, b)`` whose sketches allow the similarity."""
        part = (1 - self.similarity) / (1 + self.similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
                keep = [apart(x, y) <= part * (n + m) + 1e-6 for x, y, n, m in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = self.found.select(F.col("__row").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("xn"))
        right = self.found.select(F.col("__row").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("yn"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "xn", "yn").mapInArrow(run, PAIRS)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(a, b)`` that are similar."""
        spark, width, similarity = pairs.sparkSession, self.width, self.similarity
        pairs = materialize(self.close(pairs.distinct()), "shingle-pairs")
        wanted = pairs.select(F.col("a").alias("__row")).union(pairs.select(F.col("b").alias("__row"))).distinct()
        places = self.found.select("__row", "__file", "__at").join(wanted, "__row", "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(width)
            for batch in pieces(batches):
                made = [shingler.set_of(words_of(t)).tobytes() for t in _texts(batch, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["__row", "set"])

        texts = self.docs.select("__file", "__at", self.text_col).join(places, ["__file", "__at"]).select("__row", self.text_col)
        held = materialize(texts.mapInArrow(sets, "__row long, set binary"), "shingle-sets")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(shared >= similarity * (len(both) - shared) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = held.select(F.col("__row").alias("a"), F.col("set").alias("one"))
        right = held.select(F.col("__row").alias("b"), F.col("set").alias("two"))
        out = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two").mapInArrow(check, PAIRS), "shingle-links")
        discard(spark, held, pairs)
        return out


def _possible(x: str, y: str, similarity: float):
    """Whether two cell rows (row, n, pos) can still reach the similarity."""
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return rest >= F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6


def _mixed(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``cells(token, row, n, pos)`` with their component, of cells that hold more than one."""
    named = cells.join(components(links).withColumnRenamed("node", "row"), "row", "left").select("token", "row", "n", "pos", F.coalesce("component", "row").alias("component"))
    apart = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min(F.struct("row", "n", "pos")).alias("lead")).where("lo <> hi")
    return named.join(apart.select("token", "size", "lead"), "token")


def links(cells: DataFrame, confirm: Confirm, near: DataFrame, similarity: float) -> DataFrame:
    """(a, b): confirmed pairs that connect exactly what similar pairs of ``cells(token, row, n, pos)`` connect; ``near`` are links known already."""
    spark = cells.sparkSession
    shared = materialize(_mixed(cells, near), "shingle-cells")
    fields = F.struct("row", "n", "pos", "component")
    small = shared.where(F.col("size") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list(fields)).alias("m"))
    small = small.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y")).where("x.component <> y.component")
    star = shared.where((F.col("size") > SMALL) & (F.col("row") > F.col("lead.row"))).select(F.col("lead").alias("x"), F.struct("row", "n", "pos").alias("y"))
    tried = small.where(_possible("x", "y", similarity)).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))
    tried = tried.unionByName(star.where(_possible("x", "y", similarity)).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")))
    found = near.unionByName(confirm(tried))
    large = shared.where(F.col("size") > SMALL).select("token", "row", "n", "pos")
    if large.isEmpty():
        return found
    for number in range(ROUNDS + 1):
        rest = _mixed(large, found).drop("lead").withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int"))
        rest = rest.join(confirm.found.select(F.col("__row").alias("row"), "sketch"), "row")
        rest = rest.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
        others = F.transform(F.expr("sequence(0, slices - 1)"), lambda k: F.struct(F.least("slice", k).alias("lo"), F.greatest("slice", k).alias("hi")))
        tasks = rest.withColumn("t", F.explode(others)).select(F.xxhash64("token", "t.lo", "t.hi").alias("task"), (F.col("t.lo") == F.col("t.hi")).alias("one"), (F.col("slice") == F.col("t.lo")).alias("left"), "row", "n", "pos", "component", "sketch")
        pairs = materialize(_close_pairs(tasks, similarity, number < ROUNDS), "shingle-close")
        if pairs.isEmpty():
            break
        more = confirm(pairs)
        discard(spark, pairs)
        found = found.unionByName(more)
    discard(spark, shared)
    return found


def _levels(sketches: list[bytes], most: int = 16) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each sketch's level, and for every level the sketches of it and above folded to 2 ** level 64-bit words."""
    words = [np.frombuffer(s, np.uint64) for s in sketches]
    own = np.array([len(w).bit_length() - 1 for w in words])
    top = min(int(own.max()), most.bit_length() - 1)
    tables = []
    for level in range(top + 1):
        table = np.zeros((len(words), 1 << level), np.uint64)
        for i, w in enumerate(words):
            if own[i] >= level:
                table[i] = np.bitwise_xor.reduce(w.reshape(-1, 1 << level), axis=0)
        tables.append(table)
    return np.minimum(own, top), tables


def _close_pairs(tasks: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """(a, b): pairs of different components in a task whose sizes, places and sketches allow the similarity.

    With ``nearest`` every row gives just the partner whose sketch is nearest.
    """
    part = (1 - similarity) / (1 + similarity)

    def compare(one: bool, left_side: np.ndarray, row: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        level, tables = _levels(sketches)
        left = np.arange(len(row)) if one else np.flatnonzero(left_side)
        right = left if one else np.flatnonzero(~left_side)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 64):
            i, j = left[at : at + 64, None], right[None, :]
            total = n[i] + n[j]
            ok = (comp[i] != comp[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= similarity / (1 + similarity) * total - 1e-6)
            p, q = np.nonzero(ok)
            p, q = left[at : at + 64][p], right[q]
            if one and not nearest:
                p, q = p[row[p] < row[q]], q[row[p] < row[q]]
            distance = np.zeros(len(p), np.int64)
            lower = np.minimum(level[p], level[q])
            for k, table in enumerate(tables):
                here = np.flatnonzero(lower == k)
                for b in range(0, len(here), 1 << 14):
                    h = here[b : b + (1 << 14)]
                    distance[h] = np.bitwise_count(table[p[h]] ^ table[q[h]]).sum(1, dtype=np.int64)
            near = distance <= part * (n[p] + n[q]) + 1e-6
            p, q, distance = p[near], q[near], distance[near]
            if nearest and len(p):
                order = np.lexsort((row[q], distance, p))
                first = order[np.concatenate([[True], p[order][1:] != p[order][:-1]])]
                p, q = p[first], q[first]
            out.append((np.minimum(row[p], row[q]), np.maximum(row[p], row[q])))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_task(batches):
            task, one, left, row, n, pos, comp = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = compare(bool(one[a]), left[a:b], row[a:b], n[a:b], pos[a:b], comp[a:b], rows.column(7).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    dealt = tasks.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, PAIRS).distinct()


def near_links(reps: DataFrame, confirm: Confirm, max_bits: int) -> DataFrame:
    """Links among ``reps(__row, fp, marks)`` that cost a few confirmations a row.

    SimHash gives rows of one fingerprint and fingerprints that the pivot tables
    bring together; beside them every row is tried with the first row of its
    marks, which connects most of a large group of looser copies.
    """
    prints = representatives(reps.select(F.col("__row").alias("doc_id"), "fp"))
    first = prints.select("fp", F.col("first").alias("a"))
    same = reps.join(first, "fp").where("__row <> a").select("a", F.col("__row").alias("b"))
    stars = similar_edges(prints, prints.count(), max_bits)
    names = prints.select(F.col("rep").alias("a"), F.col("first").alias("one")), prints.select(F.col("rep").alias("b"), F.col("first").alias("two"))
    close = stars.join(names[0], "a").join(names[1], "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    marked = reps.select("__row", F.posexplode("marks").alias("k", "mark"))
    leads = marked.groupBy("k", "mark").agg(F.min("__row").alias("a"))
    stars = marked.join(leads, ["k", "mark"]).where("__row <> a").select("a", F.col("__row").alias("b"))
    return confirm(same.unionByName(close).unionByName(stars))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id."""
    given, names = set_aside(docs)
    text, key = names[text_col], names[id_col]
    rows = with_places(given, "shingle-rows")
    found = materialize(prints(rows, width, similarity, text, key, frequent(rows, width, text)), "shingle-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    same = found.groupBy("hi", "lo").agg(F.min(order).alias("rep"))
    same = materialize(found.select("__row", "doc_id", "hi", "lo").join(same, ["hi", "lo"]).select("__row", "doc_id", F.col("rep.__row").alias("rep")), "shingle-copies")
    reps = found.select("__row", "fp", "marks", "n", "prefix").join(same.where("__row = rep").select("__row"), "__row", "left_semi")
    confirm = Confirm(rows, found, width, similarity, text)
    cells = reps.select(F.col("__row").alias("row"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = cells.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    cells = materialize(cells.join(shared, "token"), "shingle-tokens")
    near = near_links(materialize(reps.select("__row", "fp", "marks"), "shingle-fps"), confirm, max_bits)
    classes = components(links(cells, confirm, near, similarity))
    members = same.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("__row", "doc_id", F.coalesce("component", "rep").alias("class"))
    members = materialize(members, "shingle-classes")
    best = members.groupBy("class").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    losers = members.join(best, "class").where("__row <> best.__row").select("__row")
    losers = materialize(found.select("__row", "__file", "__at").join(losers, "__row", "left_semi").select("__file", "__at"), "shingle-losers")
    discard(docs.sparkSession, cells, same, members)
    return rows.join(losers, ["__file", "__at"], "left_anti").select(*names.values()).toDF(*docs.columns)
