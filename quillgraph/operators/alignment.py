"""Statements of an answer against the evidence, one to one.

Answer and evidence are cut into sentences; similarity is the F-measure of their
word sets.  The assignment of statements to evidence sentences with the largest
total similarity is found exactly, each sentence used at most once; an assigned
pair counts as supported from ``least`` on.  Precision is the share of supported
statements, recall the share of evidence sentences that support one, and F-beta
weighs the two.

A row's matrix is as large as its own sentences allow, and rows are independent,
so work spreads over all partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WORD = re.compile(r"[一-鿿]|[^\W_]+")


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """F-measure of the word sets of every two sentences."""
    sets = [[set(WORD.findall(s.lower())) for s in side] for side in (left, right)]
    number = {w: i for i, w in enumerate(sorted(set().union(*sets[0], *sets[1])))}
    flags = [np.zeros((len(side), len(number)), np.float32) for side in sets]
    for table, side in zip(flags, sets, strict=True):
        for i, words in enumerate(side):
            table[i, [number[w] for w in words]] = 1
    shared = flags[0].astype(float) @ flags[1].astype(float).T
    total = flags[0].sum(1, dtype=float)[:, None] + flags[1].sum(1, dtype=float)[None, :]
    return np.divide(2 * shared, total, out=np.zeros_like(shared), where=total > 0)


def assign(gain: np.ndarray) -> np.ndarray:
    """Column of every row in the one-to-one assignment of largest total ``gain``, -1 for rows that are left over.

    Shortest augmenting paths with prices of rows and columns; each path is found in
    one sweep of array operations per column it reaches.
    """
    if gain.size == 0:
        return np.full(len(gain), -1)
    if gain.shape[0] > gain.shape[1]:
        back = assign(gain.T)
        out = np.full(len(gain), -1)
        out[back] = np.arange(len(back))
        return out
    cost = gain.max() - gain
    rows, columns = cost.shape
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for start in range(rows):
        distance, before = np.full(columns, np.inf), np.full(columns, -1)
        done = np.zeros(columns, bool)
        row, column, reached = start, -1, 0.0
        while True:
            step = reached + cost[row] - row_price[row] - column_price
            better = ~done & (step < distance)
            distance[better], before[better] = step[better], column
            column = int(np.where(done, np.inf, distance).argmin())
            reached, done[column] = distance[column], True
            if owner[column] < 0:
                break
            row = owner[column]
        passed = done.copy()
        passed[column] = False
        row_price[start] += reached
        row_price[owner[passed]] += reached - distance[passed]
        column_price[passed] -= reached - distance[passed]
        while column >= 0:
            prior = before[column]
            owner[column] = start if prior < 0 else owner[prior]
            column = prior
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def align(rows: DataFrame, answer: Column, evidence: Column, keep: list[str], least: float = 0.5, beta: float = 1.0) -> DataFrame:
    """Columns ``keep`` with n_statements, n_evidence, n_supported, total, precision, recall and f_beta of every row; nothing stated gives zeros."""
    keep = [c for c in keep if c not in ("n_statements", "n_evidence", "n_supported", "total")]
    given = rows.select(*keep, X.sentences(answer, "generator").alias("__left"), X.sentences(evidence, "generator").alias("__right"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for left, right in zip(f["__left"], f["__right"], strict=True):
                gain = similarities(list(left), list(right))
                to = assign(gain)
                scores = gain[np.flatnonzero(to >= 0), to[to >= 0]] if gain.size else np.zeros(0)
                found.append((len(left), len(right), int((scores >= least - 1e-12).sum()), float(scores.sum())))
            yield f[keep].assign(**{c: [r[i] for r in found] for i, c in enumerate(("n_statements", "n_evidence", "n_supported", "total"))})

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name in keep)
    out = given.mapInPandas(run, f"{names}n_statements long, n_evidence long, n_supported long, total double")
    share = lambda n: F.when(F.col(n) > 0, F.col("n_supported") / F.col(n)).otherwise(0.0)
    out = out.withColumn("precision", share("n_statements")).withColumn("recall", share("n_evidence"))
    weighed = (1 + beta * beta) * F.col("precision") * F.col("recall") / (beta * beta * F.col("precision") + F.col("recall"))
    return out.withColumn("f_beta", F.when(F.col("n_supported") > 0, weighed).otherwise(0.0))
