"""Entity resolution (A13, F2, J4) and ROUGE-L (A35): the parts that are sequences of decisions."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..storage import materialize
from .components import components


def signature(text: str) -> str:
    low = re.sub(r"[\s\-_/.]+", "", text.casefold().strip())
    return re.sub(r"[^0-9a-z㐀-䶿一-鿿豈-﫿]+", "", low)


def initials(text: str) -> str:
    words = re.findall(r"[A-Za-z0-9]+", text)
    return "".join(w[0] for w in words).casefold() if len(words) > 1 else ""


def merge_entities(rows: list[dict]) -> list[dict]:
    """In order, an entity joins the first earlier one of its type with a common signature (greedy, not transitive).

    Aliases and chunks unite, the largest confidence and the first description stay.
    """
    merged: list[dict] = []
    for row in rows:
        marks = {s for n in [row["name"], *row["aliases"]] for s in (signature(n), initials(n)) if s}
        home = next((m for m in merged if m["entity_type"] == row["entity_type"] and m["marks"] & marks), None)
        if home is None:
            merged.append({"name": row["name"], "entity_type": row["entity_type"], "aliases": list(dict.fromkeys(row["aliases"])), "chunks": sorted(set(row["chunks"])), "confidence": row["confidence"], "description": row["description"], "marks": marks})
            continue
        home["aliases"] = [a for a in dict.fromkeys([*home["aliases"], row["name"], *row["aliases"]]) if a != home["name"]]
        home["chunks"] = sorted({*home["chunks"], *row["chunks"]})
        home["confidence"] = max(home["confidence"], row["confidence"])
        home["description"] = home["description"] or row["description"]
        home["marks"] |= marks
    return [{k: v for k, v in m.items() if k != "marks"} for m in merged]


MERGED = "entity_type string, name string, aliases array<string>, chunks array<string>, confidence double, description string"


def merge_by_type(entities: DataFrame) -> DataFrame:
    """A13 over a table entities(entity_type, seq, name, aliases, chunks, confidence, description).

    An entity can only join one with a common signature, so the greedy order
    couples nothing beyond a connected set of signatures: rows of a type are
    grouped by those, and each group is merged on its own.  Identical names are
    united before.
    """
    same = entities.groupBy("entity_type", "name").agg(
        F.min("seq").alias("seq"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"),
        F.max("confidence").alias("confidence"), F.min_by("description", F.when(F.col("description") != "", F.col("seq"))).alias("description"),
    )
    same = materialize(same.withColumn("__node", F.monotonically_increasing_id()), "entities")

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            listed = [sorted({s for n in [name, *aliases] for s in (signature(n), initials(n)) if s}) for name, aliases in zip(f["name"], f["aliases"], strict=True)]
            yield f[["__node", "entity_type"]].assign(mark=listed).explode("mark").dropna()

    marked = same.select("__node", "entity_type", "name", "aliases").mapInPandas(marks, "__node long, entity_type string, mark string")
    first = marked.groupBy(F.coalesce("entity_type", F.lit("")).alias("t"), "mark").agg(F.min("__node").alias("b"))
    links = marked.join(first, (F.coalesce("entity_type", F.lit("")) == F.col("t")) & (marked["mark"] == first["mark"])).select(F.col("__node").alias("a"), "b").where("a <> b")
    grouped = same.join(components(links).withColumnRenamed("node", "__node"), "__node", "left").withColumn("component", F.coalesce("component", "__node"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("seq").to_dict("records")
        done = merge_entities([r | {"aliases": list(r["aliases"]), "chunks": list(r["chunks"]), "description": r["description"] or ""} for r in rows])
        return pd.DataFrame(done, columns=["entity_type", "name", "aliases", "chunks", "confidence", "description"])

    return grouped.groupBy("component").applyInPandas(run, MERGED)


def fuzzy_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def lengths_near(n: int, least: float) -> range:
    """Lengths of names that can match a name of ``n`` letters."""
    return range(max(1, math.ceil(n * least / (2 - least) - 1e-9)), math.floor(n * (2 - least) / least + 1e-9) + 1)


def shared_pairs(n: int, least: float) -> int:
    """Letter pairs that a name of ``n`` letters shares with every match, at the least.

    Let m be the other length and u = n + m - 2M the letters outside the M matched
    ones, u <= (1 - least) (n + m).  The matched blocks are one more than u at most,
    so the names share M - u - 1 neighbouring pairs or more.
    """
    return min(((n + m - u) // 2 - u - 1 for m in lengths_near(n, least) for u in [math.floor((1 - least) * (n + m) + 1e-9)]), default=0)


def gram_prefix(name: str, least: float) -> list[str]:
    """The first of a name's n - 1 numbered letter pairs in one fixed order, so many that one of them is shared with every match; none if no pair is sure to be."""
    shared = shared_pairs(len(name), least)
    if shared < 1:
        return []
    seen, grams = {}, []
    for i in range(len(name) - 1):
        pair = name[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        grams.append(f"{pair}\x00{seen[pair]}")
    return sorted(grams, key=lambda g: hashlib.md5(g.encode()).digest())[: len(name) - shared]


def name_cells(name: str, least: float, asks: bool) -> list[str]:
    """Where a name meets its matches: its prefix pairs, and lengths where either side is too short for them."""
    n = len(name)
    short = lambda k: shared_pairs(k, least) < 1
    lengths = [m for m in lengths_near(n, least) if short(n) or short(m)]
    return [*gram_prefix(name, least), *(f"length\x00{m}" for m in (lengths if asks else [n] if lengths else []))]


def fuzzy_match(names: DataFrame, known: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, known, ratio): the best known name with a matching ratio of ``least`` or more.

    Names meet by a shared letter pair out of their prefixes (:func:`gram_prefix`),
    names too short for that by length; no match is lost.
    """

    def keys(df: DataFrame, column: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cells = [name_cells(x, least, column == "name") for x in f[column]]
                yield pd.DataFrame({column: f[column], "cell": cells}).explode("cell").dropna()

        return df.mapInPandas(run, f"{column} string, cell string")

    a = keys(names.select("name").where("name is not null").distinct(), "name")
    b = keys(known.select(F.col("name").alias("known")).where("known is not null").distinct(), "known")
    near = (F.length("known") >= F.length("name") * (least / (2 - least)) - 1e-9) & (F.length("name") >= F.length("known") * (least / (2 - least)) - 1e-9)
    pairs = a.join(b, "cell").where(near).select("name", "known").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "known": f["known"], "ratio": [fuzzy_ratio(x, y) for x, y in zip(f["name"], f["known"], strict=True)]})

    scored = pairs.mapInPandas(run, "name string, known string, ratio double").where(F.col("ratio") >= least)
    return scored.groupBy("name").agg(F.max_by(F.struct("known", "ratio"), F.struct(F.col("ratio"), "known")).alias("b")).select("name", "b.known", "b.ratio")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two number sequences, a row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        # the best of above and, where the words match, one more than above left; then carried to the right
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == x)))
    return int(row[-1])


def rouge_l(reference: str, candidate: str, stemming: bool = True) -> float:
    """F-measure of the longest common word subsequence, lower case; words of more than three letters are stemmed."""
    number: dict[str, int] = {}
    known = lambda w: stem(w) if stemming and len(w) > 3 else w
    a, b = (np.array([number.setdefault(known(w), len(number)) for w in re.findall(r"[a-z0-9]+", t.lower())], np.int64) for t in (reference, candidate))
    if not len(a) or not len(b):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def rouge_scores(pairs: DataFrame) -> DataFrame:
    """A35 over a table: ``pairs(..., reference, candidate)`` with rouge_l, by Arrow batch."""
    keep = [c for c in pairs.columns if c not in ("reference", "candidate")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[keep].assign(rouge_l=[rouge_l(x or "", y or "") for x, y in zip(f["reference"], f["candidate"], strict=True)])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keep)
    return pairs.mapInPandas(run, f"{names}, rouge_l double")


def fuzzy_ratios(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ratio, the matching ratio of two columns, by Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ratio=[fuzzy_ratio(x or "", y or "") for x, y in zip(f[left], f[right], strict=True)])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{names}, ratio double")
