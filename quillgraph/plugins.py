"""Seams for models (U1-U7) with deterministic defaults: embeddings, rerankers, judges, answers, and the retry wrapper.

A plug-in works on Arrow batches inside executors, so it is made there by its
``load`` and never shipped with weights.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelPlugin(Protocol):
    """A model that maps a batch of texts to a batch of values."""

    def load(self) -> Callable[[list[str]], list]: ...


class Provider(Protocol):
    """A retrieval channel over a table of questions."""

    name: str

    def retrieve(self, queries: DataFrame) -> DataFrame: ...


class Predictor(Protocol):
    """An assertion label for (text, entity)."""

    def predict(self, text: str, entity: str) -> str: ...


@dataclass
class HashingEmbedder:
    """PRJ4's default: signed feature hashing of words, unit length; the same everywhere."""

    dims: int = 64

    def load(self) -> Callable[[list[str]], list]:
        import xxhash

        def embed(texts: list[str]) -> list:
            out = np.zeros((len(texts), self.dims), np.float32)
            for i, t in enumerate(texts):
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % self.dims] += 1.0 if h >> 63 else -1.0
                n = float(np.linalg.norm(out[i]))
                if n:
                    out[i] /= n
            return list(out)

        return embed


@dataclass
class OverlapScorer:
    """R12's and A34's default: the share of a question's words that a text holds."""

    def load(self) -> Callable[[list[str]], list]:
        def score(pairs: list[str]) -> list:
            out = []
            for pair in pairs:
                q, _, t = pair.partition("\u0001")
                want, have = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", t.lower()))
                out.append(len(want & have) / len(want) if want else 0.0)
            return out

        return score


#: Rows of a frame that go back at once.
PART = 256


def apply_plugin(df: DataFrame, plugin: ModelPlugin, inputs: str, output: str, kind: str, batch: int = 64, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``output`` of SQL type ``kind`` made from the string column ``inputs``, in batches."""
    kept = df.columns if keep is None else keep
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = plugin.load()
        step = max(1, PART // batch) * batch
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at : at + step]
                values: list = []
                texts = part[inputs].fillna("").tolist()
                for i in range(0, len(texts), batch):
                    values += model(texts[i : i + batch])
                yield part[kept].assign(**{output: values})

    return df.mapInPandas(run, f"{names}`{output}` {kind}")


def embed(df: DataFrame, text_col: str = "content", plugin: ModelPlugin | None = None) -> DataFrame:
    """PRJ4, PRJ5: ``df`` with an embedding of its text."""
    return apply_plugin(df, plugin or HashingEmbedder(), text_col, "embedding", "array<float>")


def relevance(df: DataFrame, query_col: str, text_col: str, plugin: ModelPlugin | None = None) -> DataFrame:
    """``df`` with relevance of text to query."""
    joined = df.withColumn("__pair", F.concat_ws("\u0001", F.coalesce(query_col, F.lit("")), F.coalesce(text_col, F.lit(""))))
    return apply_plugin(joined, plugin or OverlapScorer(), "__pair", "relevance", "double", keep=df.columns)


# What transient failures say.
TRANSIENT_MARKS = ("504", "503", "502", "500", "429", "gateway time-out", "gateway timeout", "rate limit", "temporarily unavailable", "timed out", "timeout", "connection reset", "connection aborted", "connection error", "eof occurred", "retryable")


def transient(error: Exception) -> bool:
    """A status of the server's or of overload, or a message that says so."""
    status = getattr(error, "status_code", None)
    return (status is not None and (status in (408, 409, 429) or status >= 500)) or any(m in str(error).lower() for m in TRANSIENT_MARKS)


class CallFailed(RuntimeError):
    """A call that was given up."""


@dataclass
class RetryingCall:
    """Retries of transient failures with exponential back-off and jitter, a circuit after repeated ones, a total time budget, an abort hook.

    Errors that are not transient are raised as they are and count for nothing;
    the last transient one is raised too once the retries are used up.
    """

    max_retries: int = 3
    first_wait: float = 1.0
    longest_wait: float = 30.0
    jitter: float = 0.2
    max_failures_in_row: int = 5
    budget: float | None = None
    retryable: Callable[[Exception], bool] = lambda e: transient(e)
    should_abort: Callable[[], bool] = lambda: False
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    failures: int = 0
    started: float | None = field(default=None)

    def wait(self, error: Exception, attempt: int) -> float:
        asked = getattr(error, "retry_after", None)
        if asked is None and (found := re.search(r"retry_after['\"]?\s*[:=]\s*(\d+(?:\.\d+)?)", str(error), re.IGNORECASE)):
            asked = found[1]
        return min(self.longest_wait, float(asked) if asked is not None else self.first_wait * 2**attempt) + random.random() * self.jitter

    def __call__(self, f: Callable, *args, **kwargs):
        self.started = self.clock() if self.started is None else self.started
        for attempt in range(self.max_retries + 1):
            if self.should_abort():
                raise CallFailed("aborted")
            if self.budget is not None and self.clock() - self.started > self.budget:
                raise CallFailed("the time budget is used up")
            try:
                value = f(*args, **kwargs)
            except Exception as error:
                if not self.retryable(error):
                    raise
                self.failures += 1
                if self.failures >= self.max_failures_in_row:
                    raise CallFailed(f"the circuit is open after {self.failures} failures: {error}") from error
                if attempt == self.max_retries:
                    raise
                pause = self.wait(error, attempt)
                if self.budget is not None and self.clock() - self.started + pause > self.budget:
                    raise CallFailed(f"the time budget is used up: {error}") from error
                self.sleep(pause)
            else:
                self.failures = 0
                return value
        raise CallFailed("no attempt was made")


def embed_phrases(df: DataFrame, plugin: ModelPlugin | None = None) -> DataFrame:
    """PRJ5: ``df(name, entity_type)`` with the embedding of "name: type"."""
    text = F.concat_ws(": ", F.coalesce("name", F.lit("")), F.coalesce("entity_type", F.lit("")))
    return embed(df.withColumn("__phrase", text), "__phrase", plugin).drop("__phrase")


def enrichment_mode(chunks: DataFrame, by: str, most_chunks: int = 6, most_chars: int = 5000) -> DataFrame:
    """PRJ3: per document (n_chunks, n_chars, mode): small ones get the light context, larger ones a model where one is plugged in."""
    sizes = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    return sizes.withColumn("mode", F.when((F.col("n_chunks") <= most_chunks) & (F.col("n_chars") <= most_chars), "light").otherwise("model"))


def expand_queries(queries: DataFrame, n: int, rewrite=None) -> DataFrame:
    """``n`` variants of each query, numbered from 1: the rewriter's (a column function of query and number), else the query itself."""
    rows = queries.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows if rewrite is None else rows.withColumn("query", F.coalesce(rewrite(F.col("query"), F.col("variant")), "query"))


def guarded_labels(rows: DataFrame, text_col: str, entity_col: str, model: Column | None = None, model_confidence: Column | None = None, threshold: float = 0.75, **cues) -> DataFrame:
    """``rows`` with label and labeler: a confident rule that is not "affirmed" stands, else a confident model, else the rule.

    ``model`` and ``model_confidence`` are a model's columns; without them the rules label everything.
    """
    from .operators.policy import classify_assertion

    ruled = rows.withColumn("__d", classify_assertion(F.col(text_col), F.col(entity_col), **cues))
    label, sure = F.col("__d.label"), (F.col("__d.label") != "affirmed") & (F.col("__d.confidence") >= threshold)
    if model is None:
        return ruled.withColumn("label", label).withColumn("labeler", F.lit("rules")).drop("__d")
    use = ~sure & F.coalesce(model_confidence >= threshold, F.lit(False)) & model.isNotNull()
    return ruled.withColumn("label", F.when(use, model).otherwise(label)).withColumn("labeler", F.when(use, "model").otherwise("rules")).drop("__d")


def marked(text: Column, entity: Column) -> Column:
    """the text with its first mention of the entity between marks."""
    at = F.call_function("position", entity, text)
    return F.when((at > 0) & (entity != ""), F.concat(F.left(text, at - 1), F.lit("[E]"), entity, F.lit("[/E]"), F.substr(text, at + F.length(entity), F.length(text)))).otherwise(text)


class TraceStore(Protocol):
    """Where traces are kept; :mod:`quillgraph.streaming.state` and SNK8's tables are two of them."""

    def put(self, trace: dict) -> None: ...

    def get(self, trace_id: str) -> dict | None: ...

    def session(self, session_id: str, limit: int = 20) -> list[dict]: ...


class MemoryTraces:
    """U3's default: the newest ``most`` traces, and the last ``per_session`` of each session."""

    def __init__(self, most: int = 100, per_session: int = 20):
        self.most, self.per_session = most, per_session
        self.traces: dict[str, dict] = {}
        self.sessions: dict[str, list[dict]] = {}

    def put(self, trace: dict) -> None:
        self.traces.pop(trace["trace_id"], None)
        self.traces[trace["trace_id"]] = trace
        while len(self.traces) > self.most:
            self.traces.pop(next(iter(self.traces)))
        if trace.get("session_id"):
            self.sessions[trace["session_id"]] = [*self.sessions.get(trace["session_id"], []), trace][-self.per_session :]

    def get(self, trace_id: str) -> dict | None:
        return self.traces.get(trace_id)

    def session(self, session_id: str, limit: int = 20) -> list[dict]:
        return self.sessions.get(session_id, [])[-limit:]


class Tools(dict):
    """U4: tools by name; a tool takes a table of questions and gives results."""

    def register(self, name: str):
        def note(tool):
            if name in self:
                raise ValueError(f"{name} is registered twice")
            self[name] = tool
            return tool

        return note

    def run(self, name: str, queries: DataFrame) -> DataFrame:
        if name not in self:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self))}")
        return self[name](queries)


def results_summary(results: DataFrame, key: str = "query_id", most: int = 5, chars: int = 400) -> DataFrame:
    """X11: (key, summary): a judge's view of the first results of results(key, rank, score, content), ranked before they are collected."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("rank")
    line = F.concat(F.lit("[Chunk "), F.col("__r").cast("string"), F.format_string(" | score=%.2f] ", F.col("score").cast("double")), F.left(F.coalesce("content", F.lit("")), F.lit(chars)))
    top = results.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).select(key, "__r", line.alias("__t"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__t"))), lambda x: x["__t"]), "\n\n").alias("summary"))
