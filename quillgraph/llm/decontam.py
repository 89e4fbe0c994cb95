"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters.
A window is ``n`` consecutive words of an item; an item of fewer words is one
window.  The benchmark's words get small numbers and every window a rolling hash
of its numbers; what is broadcast is the vocabulary and flat arrays: one line of
word numbers, and per window length the sorted hashes with a place in that line
and the item.  A bit table of hashes throws out nearly all document positions at
once; the rest are looked up and verified word by word against the line, so hits
are exact.  Document words inside a verified window are hit.

The broadcast holds the benchmark, not the corpus, and its bytes are bounded
before it is made: where words and distinct words would take more than
``max_broadcast_bytes``, :func:`scan` joins document windows with benchmark
windows by a 64-bit hash instead and compares what meets word by word.

Edge cases: a null or word-less document has n_words 0 and no hits; null and
word-less items have no window; an item without an id hits like any other and
is listed as null, once; repeated items are distinct items with the same windows;
items of one id are one item; ids may be strings; repeated documents are scanned each; texts of any length are read
whole; an empty benchmark hits nothing, an empty table gives an empty result;
:func:`scan` replaces kept columns with the name of an output, and
:func:`decontaminate` keeps all columns as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialize
from .tables import set_aside

#: Byte classes: letters are folded to lower case, separators become blanks.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
MULT = np.uint64(0x9E3779B97F4A7C15)
OUT = ["n_words", "n_hit", "item_ids", "spans"]


#: Bytes that a word and a distinct word of the benchmark may take in the broadcast.
WORD_BYTES, DISTINCT_BYTES = 64, 160


class WindowSet:
    """Benchmark windows over numbered words, in the form that scans of documents need."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.items: list = []
        parts, by_length = [], {}
        at = 0
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.translate(FOLD).split()]
            if words:
                parts.append(np.array(words, np.uint32))
                size = min(n, len(words))
                places, owners = by_length.setdefault(size, ([], []))
                places.append(np.arange(at, at + len(words) - size + 1, dtype=np.int64))
                owners.append(np.full(len(words) - size + 1, len(self.items), np.int32))
                at += len(words)
                self.items.append(item)
        self.line = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        hashes = {size: rolling(self.line.astype(np.uint64), size) for size in by_length}
        self.tables = {}
        for size, (places, owners) in by_length.items():
            place, owner = np.concatenate(places), np.concatenate(owners)
            h = hashes[size][place]
            order = np.argsort(h, kind="stable")
            bits = max(16, (16 * len(h)).bit_length())
            table = np.zeros(1 << (bits - 3), np.uint8)
            np.bitwise_or.at(table, (h >> np.uint64(67 - bits)).astype(np.int64), np.uint8(1) << ((h >> np.uint64(64 - bits)) & np.uint64(7)).astype(np.uint8))
            self.tables[size] = (bits, table, h[order], place[order], owner[order])

    def find(self, numbers: np.ndarray) -> list[tuple[int, int, list]]:
        """(start, length, items) of every window that occurs in a sequence of word numbers (0: not in the benchmark)."""
        hits = []
        for size, (bits, table, known, place, owner) in self.tables.items():
            if len(numbers) < size:
                continue
            h = rolling(numbers, size)
            maybe = np.flatnonzero(table[(h >> np.uint64(67 - bits)).astype(np.int64)] >> ((h >> np.uint64(64 - bits)) & np.uint64(7)).astype(np.uint8) & 1)
            lo, hi = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            for at, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                same = (self.line[place[a:b, None] + np.arange(size)] == numbers[at : at + size]).all(1)
                if same.any():
                    hits.append((at, size, [self.items[i] for i in np.unique(owner[a:b][same]).tolist()]))
        return hits


def rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` numbers."""
    mixed = numbers * MULT
    mixed ^= mixed >> np.uint64(29)
    out = mixed[: len(mixed) - size + 1].copy()
    for i in range(1, size):
        out *= np.uint64(0x100000001B3)
        out += mixed[i : len(mixed) - size + 1 + i]
    out ^= out >> np.uint64(32)
    out *= MULT
    return out


def _scan_batch(texts: list[bytes | None], grams: WindowSet) -> dict[str, list]:
    get = grams.vocab.get
    counts, parts = [], []
    for text in texts:
        words = text.translate(FOLD).split() if text else []
        counts.append(len(words))
        parts.append([get(w, 0) for w in words])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.array(counts, np.int64) + 1, out=starts[1:])
    numbers = np.zeros(starts[-1], np.uint64)  # a zero between documents: no window spans two
    for at, part in zip(starts.tolist(), parts, strict=False):
        numbers[at : at + len(part)] = part
    hit: dict[int, list] = {}
    for at, size, owners in grams.find(numbers):
        hit.setdefault(int(np.searchsorted(starts, at, "right")) - 1, []).append((at, size, owners))
    out: dict[str, list] = {"n_words": counts, "n_hit": [0] * len(texts), "item_ids": [[] for _ in texts], "spans": [[] for _ in texts]}
    for doc, found in hit.items():
        spans: list[list[int]] = []
        for at, size, _ in sorted(found, key=lambda x: x[0]):
            begin, end = at - int(starts[doc]), at - int(starts[doc]) + size
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        out["spans"][doc] = [{"first": a, "end": b} for a, b in spans]
        out["n_hit"][doc] = sum(b - a for a, b in spans)
        ids = {i for _, _, owners in found for i in owners}
        out["item_ids"][doc] = sorted(ids - {None}) + [None] * (None in ids)
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, n_hit, item_ids (sorted) and spans (word ranges, merged)."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in OUT]
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("bench_text")).where("bench_text is not null")
    rows = docs.select(*keep, F.col(text_col).alias("__scanned_text"))
    listed = bench.select(F.explode(_words(F.col("bench_text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words, distinct, letters = listed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()
    if words * WORD_BYTES + distinct * DISTINCT_BYTES + letters > max_broadcast_bytes:
        return _scan_by_join(rows, bench, n, keep)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(WindowSet([(r.item, r.bench_text.encode("utf-8", "replace")) for r in bench.collect()], n))
    kind = bench.schema["item"].dataType
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_hit", "long").add("item_ids", T.ArrayType(kind)).add("spans", SPAN)
    out_types = [pa.int64(), pa.int64(), pa.list_(to_arrow_type(kind)), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()
                found = _scan_batch(texts, grams)
                cols = [pa.array(found[c], t) for c, t in zip(OUT, out_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *cols], names=[*keep, *OUT])

    return rows.mapInArrow(run, schema)


def _words(col):
    return F.regexp_extract_all(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def _scan_by_join(rows: DataFrame, bench: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """The same rows for a benchmark too large to broadcast: windows of both sides meet by hash and are compared as text."""

    def windows(words, size):
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when((F.size(words) >= size) & (size > 0), grams).otherwise(F.array().cast("array<string>"))

    items = bench.withColumn("w", _words(F.col("bench_text"))).withColumn("size", F.least(F.size("w"), F.lit(n)))
    items = items.select("item", "size", F.explode(F.array_distinct(windows(F.col("w"), F.col("size")))).alias("gram"))
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most n values
    base = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")
    base = base.withColumn("__w", F.coalesce(_words(F.col("__scanned_text")), F.array().cast("array<string>"))).drop("__scanned_text")
    ids = T.ArrayType(bench.schema["item"].dataType)
    items = items.withColumn("h", F.xxhash64("gram"))
    found = None
    for size in sizes:
        # hashes alone are shuffled; the few windows whose hash a benchmark window has are compared as text
        hashes = base.select("__row", F.posexplode(F.transform(windows(F.col("__w"), F.lit(size)), lambda g: F.xxhash64(g))).alias("first", "h"))
        part = hashes.join(items.where(F.col("size") == size), "h").join(base.select("__row", "__w"), "__row")
        part = part.where(F.array_join(F.slice("__w", F.col("first") + 1, F.lit(size)), " ") == F.col("gram"))
        part = part.select("__row", "item", F.col("first").cast("long").alias("first"), (F.col("first") + size).cast("long").alias("end"))
        found = part if found is None else found.unionByName(part)
    plain = base.withColumn("n_words", F.size("__w").cast("long")).drop("__w")
    if found is None:
        return plain.select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(ids).alias("item_ids"), F.array().cast(SPAN).alias("spans"))
    spans = found.groupBy("__row").agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda i: i["item"])).alias("item_ids"), F.sort_array(F.collect_set(F.struct("first", "end"))).alias("all"))
    merged = F.aggregate(
        "all",
        F.array().cast(SPAN),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["first"] > F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))
        ),
    )
    spans = spans.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]))
    full = plain.join(spans, "__row", "left")
    return full.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast(ids)).alias("item_ids"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def without_spans(text: str | None, spans: list) -> str | None:
    """``text`` without the words of ``spans`` (word ranges as :func:`scan` gives them)."""
    if not text or not spans:
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : starts[span["first"]]])
        at = ends[span["end"] - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or with the hit spans cut out of them (``remove="spans"``)."""
    given, names = set_aside(docs)
    text = names[text_col]
    found = scan(given, benchmark, text_col=text, **options)
    if remove == "documents":
        return found.where("n_hit = 0").select(*names.values()).toDF(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    rows = found.select(*names.values(), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text)
            texts = [without_spans(t, s) if s else t for t, s in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == where else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=list(names.values()))

    return rows.mapInArrow(cut, given.schema).toDF(*docs.columns)


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of scanned documents."""
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return ids.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The digest rows computed word by word, for tests."""
    import re

    def words(text):
        return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(k) for k in windows}
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        rows.append((doc, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return rows
