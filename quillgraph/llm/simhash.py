"""SimHash near-duplicates through pivot distance tables.

Fingerprint: A-Z lower-cased, words split at blanks, 4-word shingles with
repeats joined by a space, XXH64 (seed 42) of each; a bit is set if it is set in
over half of the hashes.  Two fingerprints link at ``max_bits`` or fewer
differing bits, and classes are the connected components of links.

Search.  Equal fingerprints collapse to their smallest doc_id first, so exact
copies cost one row.  To spread the search over tasks, the 64 bits are cut into
blocks such that linked fingerprints agree on at least one combination of
blocks (pigeonhole), and rows that share a combination meet in a cell.  Within
a cell the pivot table does the work: each fingerprint's Hamming distances to
reference fingerprints, computed once and stored beside it, are its coordinates;
since |d(x,p) - d(y,p)| <= d(x,y) for every reference p, a pair whose largest
coordinate difference is over ``max_bits`` can't link and is discarded.  In a
large cell rows sorted by the first coordinate meet only within that band.
Survivors are verified by their true distance; :func:`discards` counts both.  A cell gives back only a spanning star of
each connected set it finds, at most one row per member.

Large cells are cut into slices and each pair of slices becomes a task of its
own, so no task holds a whole hot cell and no pair is left out.

Edge cases: a null, empty or blank text has fingerprint zero and links like any
other; texts of under four words hash their whole word sequence; repeated
doc_ids have a row each; rows with a null doc_id take part in linking, and their
own class is null; ids may be strings; an empty table gives an empty result;
texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import materialize
from .tables import pieces

SEED = 42
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in (0x20, *range(9, 14)) else b for b in range(256))
#: Rows of a cell that one task compares with each other.
SLICE = 2048
N_PIVOTS = 24


def fingerprint(text: bytes | None, width: int = 4) -> int:
    words = text.translate(LOWER).split(b" ") if text else []
    words = [w for w in words if w] if b"" in words else words
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        counts += np.unpackbits(hashes[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits in a signed long."""

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__read_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = [fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


def pivots(count: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints; nearly uncorrelated, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(b"pivot", i) for i in range(count)], np.uint64)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: each fingerprint's Hamming distances to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def with_pivots(reps: DataFrame) -> DataFrame:
    """``reps(fp, rep)`` with ``at``: the row of the pivot table, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = coordinates(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(N_PIVOTS), len(table), [None, pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, rows.cast(pa.binary())], names=["fp", "rep", "at"])

    return reps.select("fp", "rep").mapInArrow(run, "fp long, rep long, at binary")


class Tally:
    """What the pivot table did: pairs met, discarded by coordinates, verified, and linked."""

    def __init__(self):
        self.met = self.discarded = self.verified = self.linked = 0

    def sift(self, fps: np.ndarray, other: np.ndarray, table: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (i, j) at ``max_bits`` or fewer, after those that a coordinate discards."""
        self.met += len(i)
        for p in range(table.shape[1]):
            near = np.abs(table[i, p] - right[j, p]) <= max_bits
            self.discarded += len(i) - int(near.sum())
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ other[j]) <= max_bits
        self.verified += len(i)
        self.linked += int(near.sum())
        return i[near], j[near]


def links_within(fps: np.ndarray, max_bits: int, other: np.ndarray | None = None, table: np.ndarray | None = None, right: np.ndarray | None = None, tally: Tally | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at ``max_bits`` or fewer differing bits: within ``fps``, or between ``fps`` and ``other``.

    ``table`` and ``right`` are the rows of the pivot table, where they are known.
    """
    tally = tally or Tally()
    table = coordinates(fps) if table is None else table
    order = np.argsort(table[:, 0], kind="stable")
    if other is None:
        right_fps, right, right_order = fps, table, order
    else:
        right_fps, right = other, coordinates(other) if right is None else right
        right_order = np.argsort(right[:, 0], kind="stable")
    first, first_right = table[order, 0].astype(np.int64), right[right_order, 0].astype(np.int64)
    lo = np.arange(1, len(order) + 1) if other is None else np.searchsorted(first_right, first - max_bits, "left")
    hi = np.searchsorted(first_right, first + max_bits, "right")
    spans = np.maximum(hi - lo, 0)
    at = 0
    while at < len(order):
        total = np.cumsum(spans[at : at + 4096])
        take = max(1, int(np.searchsorted(total, 2_000_000, "right")))
        part = spans[at : at + take]
        left = np.repeat(np.arange(at, at + take), part)
        offsets = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        i, j = order[left], right_order[lo[left] + offsets]
        at += take
        yield tally.sift(fps, right_fps, table, right, i, j, max_bits)


def _star(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``size`` nodes after joining all pairs (smallest index of its set)."""
    root = np.arange(size)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low != high
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` near-equal blocks of 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choose_blocks(n: int, max_bits: int, target: float = 64.0) -> int:
    """Fewest blocks for which a cell of ``n`` evenly spread fingerprints has under ``target`` rows; every choice is exact."""
    for extra in (1, 2, 3, 4):
        if n / 2.0 ** (64 * extra / (max_bits + extra)) < target:
            break
    return max_bits + extra


def tasks_of(reps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(task, lo, hi, slice, fp, rep, at): cells of equal blocks, cut into slices; one task per pair of slices."""
    count = choose_blocks(n, max_bits)
    blocks = _blocks(count)
    keys = []
    for number, combo in enumerate(combinations(range(count), count - max_bits)):
        mask = sum(((1 << blocks[b][1]) - 1) << blocks[b][0] for b in combo)
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    cells = reps.select("fp", "rep", F.explode(F.array(*keys)).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cells = cells.join(sizes, "cell").withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int"))
    cells = cells.withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least("slice", k).alias("lo"), F.greatest("slice", k).alias("hi")))
    tasks = cells.select("cell", "fp", "rep", "slice", F.explode(others).alias("t")).select("cell", "t.lo", "t.hi", "slice", "fp", "rep")
    tasks = tasks.withColumn("task", F.xxhash64("cell", "lo", "hi")).drop("cell")
    held = tasks.join(reps.select("rep", "at"), "rep")
    return held.repartition("task").sortWithinPartitions("task").select("task", "lo", "hi", "slice", "fp", "rep", "at")


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, the task, regrouped so that each holds whole tasks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy()
        cut = int(np.searchsorted(task, task[-1], "left"))
        if cut or (held and held[-1].column(0)[-1] != batch.column(0)[-1]):
            yield _one([*held, batch.slice(0, cut)] if cut else held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def similar_edges(reps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(a, b): stars over ``reps(fp, rep, at)`` that connect exactly what links connect; a and b are ``rep`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_task(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _compare(rows, max_bits, Tally())], names=["a", "b"])

    return tasks_of(reps, n, max_bits).mapInArrow(run, "a long, b long").where("a <> b")


def discards(reps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """One row (met, discarded, verified, linked): how many pairs of a cell the pivot table looks at and throws out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_task(batches):
            _compare(rows, max_bits, tally := Tally())
            yield pa.RecordBatch.from_pydict({k: [getattr(tally, k)] for k in ("met", "discarded", "verified", "linked")})

    counts = tasks_of(reps, n, max_bits).mapInArrow(run, "met long, discarded long, verified long, linked long")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns))


def _compare(rows: pa.RecordBatch, max_bits: int, tally: Tally) -> tuple[np.ndarray, np.ndarray]:
    """Stars of all tasks in ``rows`` (task, lo, hi, slice, fp, rep, at), sorted by task."""
    task, lows, highs, slices, fps, reps = (rows.column(i).to_numpy() for i in range(6))
    fps = fps.view(np.uint64)
    table = bytes_of(rows.column(6)).view(np.int8).reshape(-1, N_PIVOTS)
    edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
    sizes = np.diff(edges)
    out_a, out_b = [], []
    # the many small cells together: pairs at lag 1, 2, ... inside a cell
    small = sizes <= 256
    if small.any():
        cell = np.repeat(np.arange(len(sizes)), sizes)
        keep = small[cell]
        f, r, c, t = fps[keep], reps[keep], cell[keep], table[keep]
        for lag in range(1, int(sizes[small].max())):
            i = np.flatnonzero(c[lag:] == c[:-lag])
            if not len(i):
                break
            i, j = tally.sift(f, f, t, t, i, i + lag, max_bits)
            out_a.append(r[i])
            out_b.append(r[j])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _star(len(nodes), iter([(flat[: len(a)], flat[len(a) :])]))
            out_a, out_b = [nodes], [nodes[root]]
    for k in np.flatnonzero(~small):
        at = slice(edges[k], edges[k + 1])
        f, r, t = fps[at], reps[at], table[at]
        if lows[at.start] == highs[at.start]:
            root = _star(len(f), links_within(f, max_bits, table=t, tally=tally))
        else:
            left = np.flatnonzero(slices[at] == lows[at.start])
            right = np.flatnonzero(slices[at] == highs[at.start])
            root = _star(len(f), ((left[i], right[j]) for i, j in links_within(f[left], max_bits, f[right], t[left], t[right], tally)))
        out_a.append(r)
        out_b.append(r[root])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def representatives(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, rep, at, first): one row per fingerprint; rep is the fingerprint as a node, first its smallest id (null if it has none)."""
    firsts = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-firsts")
    pivoted = with_pivots(firsts.select("fp", F.col("fp").alias("rep")))
    return materialize(pivoted.join(firsts, "fp"), "simhash-reps")


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, text_col, id_col, width), "simhash")
    reps = representatives(prints)
    classes = components(similar_edges(reps, reps.count(), max_bits))
    linked = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "first", F.coalesce("component", "rep").alias("component"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "component").select("fp", "component_id")
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of texts linked by a shingle similarity of ``similarity`` or more.

    Links are found by the pivot tables first and confirmed on the shingles;
    64-bit fingerprints of texts that are just similar enough differ in some ten
    bits, so :mod:`shingle_join` finds the links that are left, exactly.
    """
    from .shingle_join import keep_one as keep

    return keep(docs, width, similarity, max_bits, text_col, id_col)
