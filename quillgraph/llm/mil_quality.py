"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words.  Every passage of the whole
text is encoded: its words and neighbouring word pairs are hashed into a learned
table whose rows are averaged, and together with some shape figures they pass a
learned tanh layer.  Gated attention (tanh gate times sigmoid gate, softmax over
the bag) weighs the passages, and a logistic layer scores the weighted passage
representation.  Table, encoder, attention and scorer are learned together from
document labels only, by Adam in numpy on the driver.

Training uses whole labelled documents, at most ``max_docs`` of them and at most
``max_bytes`` of text, chosen by a hash of id and text; all their passages are
read.  Scoring uses all passages of all rows.

Edge cases: null, empty and blank texts are a bag with one all-zero passage and
get a score like any other; without labels, or with one kind of label only, the
score is that share of label 1 (0.5 if there is none); texts of any length are
read whole; repeated rows get equal scores; an empty table gives an empty
result; a doc_id with several labels uses its smallest; a score of exactly the
threshold predicts 1; kept columns with the name of an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
#: Bits of a hashed word's or word pair's number, and the size of its learned vector.
BITS_OF_GRAM, EMBED = 12, 8
UNITS, ATTENTION = 12, 8
BLANK = np.array([b in (0x20, *range(9, 14)) for b in range(256)])


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Byte classes whose share in a passage is a figure.
CLASSES = [
    _class(lambda b: chr(b) in "#*$%&|<>"),
    _class(lambda b: chr(b) == "|"),
    _class(lambda b: 0x30 <= b <= 0x39),
    _class(lambda b: 0x41 <= b <= 0x5A),
    _class(lambda b: chr(b) in ".,;:'\"()-?"),
    _class(lambda b: chr(b) == "!"),
    _class(lambda b: b == 10),
    _class(lambda b: b >= 0x80),
]
BITS = sum((c.astype(np.uint8) << i for i, c in enumerate(CLASSES)), np.zeros(256, np.uint8))
FIGURES = len(CLASSES) + 4


class Passages:
    """Encoded input of passages: shape figures (n, FIGURES), and hashed words and pairs with each passage's number of them."""

    def __init__(self, x: np.ndarray, grams: np.ndarray, sizes: np.ndarray):
        self.x, self.grams, self.sizes = x, grams, sizes
        self.begins = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.x)

    def pick(self, rows: np.ndarray) -> Passages:
        sizes = self.sizes[rows]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Passages(self.x[rows], self.grams[np.repeat(self.begins[rows], sizes) + inner], sizes)

    @staticmethod
    def join(parts: list[Passages]) -> Passages:
        return Passages(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("x", "grams", "sizes")))


def figures(texts: list[bytes]) -> tuple[Passages, np.ndarray]:
    """The passages of all texts, and each text's number of passages (1 at least)."""
    raw = np.frombuffer(b"\x0b".join(texts) + b"\x0b", np.uint8)
    blank = BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    first = np.searchsorted(starts, begins)
    words = np.diff(np.concatenate([first, [len(starts)]]))
    counts = np.maximum(1, -(-words // PASSAGE))
    out = np.zeros((int(counts.sum()), FIGURES), np.float32)
    sizes = np.zeros(len(out), np.int64)
    if not len(starts):
        return Passages(out, np.zeros(0, np.uint16), sizes), counts
    # passages of texts that have words: their first words, then everything by reduceat
    live = np.flatnonzero(words)
    n = counts[live]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    head = np.repeat(first[live], n) + inner * PASSAGE
    size = np.minimum(PASSAGE, np.repeat(first[live] + words[live], n) - head)
    row = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]])[live], n) + inner
    cuts = starts[head]
    bounds = np.sort(np.concatenate([cuts, begins + lengths]))  # a passage ends at the next one or at its text's end
    at = np.searchsorted(bounds, cuts)
    span = (bounds[at + 1] - cuts).astype(np.float32)
    flags = BITS[raw]
    for i in range(len(CLASSES)):
        out[row, i] = np.add.reduceat((flags >> i) & 1, bounds, dtype=np.int32)[at] / span
    letters = np.add.reduceat(~blank, bounds, dtype=np.int32)[at]
    out[row, 8] = letters / size / 16
    out[row, 9] = size / PASSAGE
    # words as numbers: bytes times powers of an odd base, summed
    place = np.zeros(len(raw), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    power = POWERS[np.minimum(place, len(POWERS) - 1)]
    value = np.where(blank, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * power)
    word = np.add.reduceat(value, starts)
    word ^= word >> np.uint64(31)
    owner = np.repeat(np.arange(len(head)), size)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])])
    out[row, 10] = np.add.reduceat(again, np.cumsum(size) - size, dtype=np.int32) / size
    key = (owner.astype(np.uint64) << np.uint64(40)) | (word & np.uint64((1 << 40) - 1))
    key.sort()
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    out[row, 11] = 1 - np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(head)) / size
    # every word, and beside it its pair with the next one (the last word of a passage is paired with nothing)
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    after = np.where(last, np.uint64(0), np.concatenate([word[1:], word[:1]]))
    grams = np.stack([word * SPREAD, (word + after * POWERS[1]) * SPREAD], axis=1).reshape(-1) >> np.uint64(64 - BITS_OF_GRAM)
    sizes[row] = 2 * size
    return Passages(out, grams.astype(np.uint16), sizes), counts


SPREAD = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


class Model:
    def __init__(self, share: float = 0.5, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(FIGURES), np.ones(FIGURES)
        self.table = (rng.normal(size=(1 << BITS_OF_GRAM, EMBED)) * 0.1).astype(np.float64)
        self.enc, self.enc_b = draw(FIGURES + EMBED, UNITS), np.zeros(UNITS)
        self.att_v, self.att_u, self.att_w = draw(UNITS, ATTENTION), draw(UNITS, ATTENTION), draw(ATTENTION, 1)[:, 0]
        self.out, self.out_b = draw(UNITS, 1)[:, 0], np.zeros(1)
        self.constant: float | None = share

    def _inputs(self, p: Passages) -> np.ndarray:
        """Normalised figures beside the mean vector of each passage's words and pairs."""
        mean = np.zeros((len(p), EMBED))
        full = np.flatnonzero(p.sizes)
        if len(full):
            mean[full] = np.add.reduceat(self.table[p.grams], p.begins[full]) / p.sizes[full, None]
        return np.concatenate([(p.x - self.mean) / self.scale, mean], axis=1)

    def _parts(self, p: Passages, bags: np.ndarray):
        """Everything the score is made of; ``bags`` is each passage's bag number, ascending, without gaps."""
        f = self._inputs(p)
        h = np.tanh(f @ self.enc + self.enc_b)
        v, u = np.tanh(h @ self.att_v), 1 / (1 + np.exp(-(h @ self.att_u)))
        e = (v * u) @ self.att_w
        cuts = np.flatnonzero(np.concatenate([[True], bags[1:] != bags[:-1]]))
        e = np.exp(e - np.maximum.reduceat(e, cuts)[bags])
        a = e / np.add.reduceat(e, cuts)[bags]
        z = np.add.reduceat(a[:, None] * h, cuts)
        y = 1 / (1 + np.exp(-(z @ self.out + self.out_b)))
        return f, h, v, u, a, z, y, cuts

    def score(self, p: Passages, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self._parts(p, np.repeat(np.arange(len(counts)), counts))[6]

    def attention(self, text: str) -> np.ndarray:
        """Weight of every passage of a text."""
        p, counts = figures([text.encode()])
        return self._parts(p, np.zeros(int(counts[0]), np.int64))[4]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.enc, self.enc_b, self.att_v, self.att_u, self.att_w, self.out, self.out_b]

    def train(self, p: Passages, counts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, min_steps: int = 300, seed: int = 3) -> None:
        if not len(y) or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.constant = None
        self.mean, self.scale = p.x.mean(0).astype(np.float64), p.x.std(0).astype(np.float64) + 1e-3
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second, step = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        epochs = max(epochs, -(-min_steps // -(-len(y) // batch)))
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                rows = np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in pick])
                grads = self._gradients(p.pick(rows), np.repeat(np.arange(len(pick)), counts[pick]), y[pick])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    g = g + decay * q
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, p: Passages, bags: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f, h, v, u, a, z, given, cuts = self._parts(p, bags)
        d = (given - y) / len(y)
        d_z = d[:, None] * self.out
        d_a = (d_z[bags] * h).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, cuts)[bags])
        d_gate = d_e[:, None] * self.att_w
        d_v, d_u = d_gate * u * (1 - v * v), d_gate * v * u * (1 - u)
        d_h = a[:, None] * d_z[bags] + d_v @ self.att_v.T + d_u @ self.att_u.T
        d_in = d_h * (1 - h * h)
        d_mean = (d_in @ self.enc[FIGURES:].T) / np.maximum(p.sizes, 1)[:, None]
        owner = np.repeat(np.arange(len(p)), p.sizes)
        d_table = np.stack([np.bincount(p.grams, weights=d_mean[owner, k], minlength=len(self.table)) for k in range(EMBED)], axis=1)
        return [d_table, f.T @ d_in, d_in.sum(0), h.T @ d_v, h.T @ d_u, (v * u).T @ d_e, z.T @ d, np.array([d.sum()])]


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_bytes: int = 32 << 20, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from labels of rows that are not held out: ``max_docs`` whole rows at most, and as many as ``max_bytes`` of text hold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col, F.lit(23)), id_col).limit(max_docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, _ = figures([(batch.column(2)[i].as_py() or "").encode("utf-8", "replace")])
                made = [pa.array([k.tobytes()], pa.binary()) for k in (p.x.astype("<f4"), p.grams.astype("<u2"), p.sizes.astype("<i8"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *made], names=["h", "label", "x", "grams", "sizes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text.alias("__text")).join(F.broadcast(chosen), id_col)
    # the texts of a repeated id are rows of their own, equal ones are one row
    rows = rows.select(F.xxhash64(F.xxhash64(id_col, F.lit(23)), "__text").alias("h"), "label", "__text")
    sizes = rows.groupBy("h").agg(F.min(F.octet_length("__text")).alias("size")).orderBy("h").limit(max_docs).collect()
    taken, left = [], max_bytes
    for r in sizes:
        if r.size <= left:
            taken.append((r.h,))
            left -= r.size
    picked = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "h long")), "h").groupBy("h").agg(F.max("label").alias("label"), F.max("__text").alias("__text"))
    got = sorted(picked.mapInArrow(encode, "h long, label double, x binary, grams binary, sizes binary").collect(), key=lambda r: (r.h, r.label, bytes(r.x)))
    model = Model()
    bags = [Passages(np.frombuffer(bytes(r.x), "<f4").reshape(-1, FIGURES), np.frombuffer(bytes(r.grams), "<u2"), np.frombuffer(bytes(r.sizes), "<i8")) for r in got]
    everything = Passages.join(bags) if bags else figures([b""])[0].pick(np.zeros(0, np.int64))
    model.train(everything, np.array([len(b) for b in bags], np.int64), np.array([r.label for r in got]))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns ``keep`` with score and predicted."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()]
                p = shared.value.score(*figures(texts))
                out = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *out], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text_col).alias("__read_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Columns ``keep`` with held_out, score and predicted."""
    model = fit(docs, labels, text_col=text_col, id_col=id_col, **options)
    keep = [c for c in keep if c != "held_out"]
    rows = docs.select(*keep, held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return score(rows, model, [*keep, "held_out"], "__text")
