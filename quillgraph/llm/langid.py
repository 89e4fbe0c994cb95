"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent passes read a text's bytes, one from each side, in windows
of ``WINDOW`` bytes.  A softmax over both hidden states labels every position,
and a document's score is the mean of its letter positions' probabilities, over
the whole text.  The network is trained in numpy by backpropagation through
time, on the driver, from a bounded sample of labelled rows.

The sample (at most ``per_lang`` whole rows and ``windows_per_lang`` windows of
each language, chosen by a hash of id and text) is the only bounded part: every
labelled language, up to ``max_langs``, is learned and every row is scored whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0; one
learned language gives that language; without any labelled row everything with
letters is ``und``; ties between languages go to the first by code point; texts
of any length are read whole, in windows; repeated rows get equal results and
are learned once; null and repeated ids are sampled like others; an
empty table gives an empty result; kept columns with the name of an output are
replaced by :func:`identify`, and stay as they are in :func:`keep_identified`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import pieces, set_aside

WINDOW, HIDDEN, BATCH = 128, 8, 2048
IS_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent pass; rows are units, columns are windows."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.table = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)  # input weights and bias by byte
        self.recur = (rng.normal(size=(3 * hidden, hidden)) * hidden**-0.5).astype(np.float32)

    def forward(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (time, units, windows) for bytes (time, windows)."""
        k = self.hidden
        state = np.zeros((k, x.shape[1]), np.float32)
        out = np.empty((len(x), k, x.shape[1]), np.float32)
        for t in range(len(x)):
            given = self.table.take(x[t], axis=1)
            own = self.recur @ state
            gates = _sigmoid(given[: 2 * k] + own[: 2 * k])
            reset, keep = gates[:k], gates[k:]
            fresh = own[2 * k :] * reset
            fresh += given[2 * k :]
            np.tanh(fresh, out=fresh)
            if trace is not None:
                trace.append((state, own[2 * k :].copy(), reset, keep, fresh))
            state = state - fresh
            state *= keep
            state += fresh
            out[t] = state
        return out

    def backward(self, x: np.ndarray, trace: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``table`` and ``recur`` from those of the hidden states, through time."""
        k = self.hidden
        d_recur = np.zeros_like(self.recur)
        inputs = np.empty((len(x), 3 * k, x.shape[1]), np.float32)
        d_state = np.zeros_like(grads[0])
        for t in range(len(x) - 1, -1, -1):
            before, own, reset, keep, fresh = trace[t]
            d_state = d_state + grads[t]
            d_fresh = d_state * (1 - keep) * (1 - fresh * fresh)
            d_keep = d_state * (before - fresh) * keep * (1 - keep)
            d_reset = d_fresh * own * reset * (1 - reset)
            inputs[t] = np.concatenate([d_reset, d_keep, d_fresh])
            pushed = np.concatenate([d_reset, d_keep, d_fresh * reset])
            d_recur += pushed @ before.T
            d_state = d_state * keep + self.recur.T @ pushed
        flat = inputs.transpose(1, 0, 2).reshape(3 * k, -1)
        d_table = np.stack([np.bincount(x.reshape(-1), weights=row, minlength=256) for row in flat]).astype(np.float32)
        return d_table, d_recur


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.left, self.right = Direction(rng, hidden), Direction(rng, hidden)
        self.head = (rng.normal(size=(len(langs), 2 * hidden)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def _states(self, x: np.ndarray, traces: tuple | None = None) -> np.ndarray:
        a = self.left.forward(x, traces and traces[0])
        b = self.right.forward(x[::-1], traces and traces[1])[::-1]
        return np.concatenate([a, b], axis=1)

    def _positions(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (time, languages, windows)."""
        scores = np.matmul(self.head, states) + self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def window_sums(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages): probabilities summed over each window's letter positions."""
        probs = self._positions(self._states(x))
        return np.einsum("tlb,tb->bl", probs, IS_LETTER[x], optimize=False)

    def labels(self, text: str) -> list[str]:
        """The label of every byte position of a text."""
        windows = to_windows([text.encode()])[0]
        probs = self._positions(self._states(windows.T))
        best = probs.argmax(1).T.reshape(-1)[: len(text.encode())]
        return [self.langs[i] for i in best]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 11, min_steps: int = 300) -> None:
        """Adam on the cross-entropy of every letter position; x (windows, time), y (windows,). Small samples are read more often."""
        rng = np.random.default_rng(seed)
        params = [self.left.table, self.left.recur, self.right.table, self.right.recur, self.head, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        epochs = max(epochs, -(-min_steps // max(1, -(-len(x) // batch))))
        total = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                grads = self._gradients(np.ascontiguousarray(x[pick].T), y[pick])
                norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
                step += 1
                lr = rate * 0.5 * (1 + np.cos(np.pi * step / total))
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    g = g / max(1.0, norm)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        traces: tuple[list, list] = ([], [])
        states = self._states(x, traces)
        probs = self._positions(states)
        weight = IS_LETTER[x]
        probs[:, y, np.arange(len(y))] -= 1
        d_scores = probs * (weight / max(1.0, float(weight.sum())))[:, None, :]
        d_head = np.einsum("tlb,tkb->lk", d_scores, states)
        d_states = np.matmul(self.head.T, d_scores)
        k = self.left.hidden
        d_left = self.left.backward(x, traces[0], d_states[:, :k])
        d_right = self.right.backward(x[::-1], traces[1], d_states[::-1, k:])
        return [*d_left, *d_right, d_head, d_scores.sum((0, 2))[:, None]]


def to_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes padded with zeros, and each text's number of windows."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    for t, c in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += c * WINDOW
    return flat.reshape(-1, WINDOW), counts


_ascii_letter = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ascii_letter.search(text) is not None or any(map(str.isalpha, text)))


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    live = [i for i, t in enumerate(texts) if has_letter(t)] if net else []
    sums = np.zeros((len(texts), len(net.langs) if net else 1))
    # many short texts share a batch of windows and a long text spans several
    queue, size = [], 0
    for n, i in enumerate(live):
        raw = texts[i].encode("utf-8", "replace")
        for part in range(0, len(raw), WINDOW * BATCH):
            queue.append((i, raw[part : part + WINDOW * BATCH]))
            size += -(-min(len(raw) - part, WINDOW * BATCH) // WINDOW)
            if size >= BATCH:
                _drain(net, queue, sums)
                queue, size = [], 0
    if queue:
        _drain(net, queue, sums)
    for i in live:
        total = sums[i].sum()
        best = int(sums[i].argmax())
        langs[i], scores[i] = net.langs[best], float(min(1.0, sums[i][best] / total)) if total > 0 else 0.0
    return langs, scores


def _drain(net: Network, queue: list[tuple[int, bytes]], sums: np.ndarray) -> None:
    windows, counts = to_windows([t for _, t in queue])
    owner = np.repeat([i for i, _ in queue], counts)
    for at in range(0, len(windows), BATCH):
        part = net.window_sums(np.ascontiguousarray(windows[at : at + BATCH].T))
        np.add.at(sums, owner[at : at + BATCH], part)


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int = 400, windows_per_lang: int = 1200, max_langs: int = 512) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(langs, windows, labels) of whole rows: of each language at most ``per_lang`` and as many as ``windows_per_lang`` windows hold.

    Rows are chosen by a hash of id and text, so neither null nor repeated ids
    leave a language out; equal rows count once.  A language none of whose rows
    fits gives its shortest sampled row, whole.  Beyond ``max_langs`` values the most frequent are learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(17)).alias("h"))
    stats = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not stats:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = docs_share(rows.sparkSession, {r.lang: (min(1 << 20, 1 + (per_lang * 3 // 2 << 20) // r.n), r.least) for r in stats}, rows.schema["lang"].dataType)
    drawn = (F.pmod("h", F.lit(1 << 20)) < F.col("__share")) | (F.col("h") == F.col("__least"))
    sampled = rows.join(F.broadcast(share), F.col("lang") == F.col("__lang")).where(drawn)
    sizes = sampled.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("size")).orderBy("h", "lang").limit(2 * per_lang * len(stats)).collect()
    taken: dict[str, list[int]] = {r.lang: [] for r in stats}
    left = dict.fromkeys(taken, windows_per_lang)
    for r in sizes:
        if len(taken[r.lang]) < per_lang and (need := -(-r.size // WINDOW)) <= left[r.lang]:
            taken[r.lang].append(r.h)
            left[r.lang] -= need
    for r in sorted(sizes, key=lambda r: (r.size, r.h)):
        if not taken[r.lang]:
            taken[r.lang].append(r.h)
    chosen = rows.sparkSession.createDataFrame([(h,) for hs in taken.values() for h in hs], "h long").distinct()
    texts = rows.join(F.broadcast(chosen), "h").groupBy("lang", "h").agg(F.max("text").alias("text")).collect()
    langs = sorted(taken)
    number = {lang: i for i, lang in enumerate(langs)}
    held = {lang: set(hs) for lang, hs in taken.items()}
    windows, labels = [], []
    for r in sorted(texts, key=lambda r: (r.h, number.get(r.lang, -1))):
        if r.h in held.get(r.lang, ()):
            raw = r.text.encode("utf-8", "replace")
            for at in range(0, len(raw), WINDOW):
                if at == 0 or len(raw) - at >= WINDOW // 4:  # a short rest teaches little
                    windows.append(raw[at : at + WINDOW])
                    labels.append(number[r.lang])
    return langs, to_windows(windows)[0], np.array(labels, np.int64)


def docs_share(spark, shares: dict, kind) -> DataFrame:
    """(__lang, __share, __least): one row per language, the hash range that its sample is taken from and its smallest hash."""
    fields = [T.StructField("__lang", kind), T.StructField("__share", T.LongType()), T.StructField("__least", T.LongType())]
    return spark.createDataFrame([(lang, *values) for lang, values in shares.items()], T.StructType(fields))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **sample) -> Network | None:
    langs, x, y = training_sample(labelled, text_col, lang_col, id_col, **sample)
    if not langs:
        return None
    net = Network(langs)
    net.train(x, y)
    return net


def score(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score; the network (a few kB) is broadcast."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores = predict(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).alias("__read_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """True for rows that training must not see."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identify(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **sample) -> DataFrame:
    """Columns ``keep`` with held_out, lang_pred and score, by a network trained on the rows not held out."""
    net = fit(docs.where(~held_out(id_col)), text_col, lang_col, id_col, **sample)
    keep = [c for c in keep if c != "held_out"]
    rows = docs.select(*keep, held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return score(rows, net, [*keep, "held_out"], "__text")


def keep_identified(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **sample) -> DataFrame:
    """``docs`` without rows that are ``und`` or whose best language scores below ``min_score``."""
    given, names = set_aside(docs)
    found = identify(given, list(names.values()), names[text_col], names[lang_col], names[id_col], **sample)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*names.values()).toDF(*docs.columns)
