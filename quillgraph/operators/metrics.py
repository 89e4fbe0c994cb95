"""Evaluation and monitoring aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def share(test: Column) -> Column:
    return F.avg(test.cast("int"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n)."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_label(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from confusion cells."""
    by_gold = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = by_gold.join(by_pred, "label", "full").fillna(0)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    return rows.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """A33."""
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def grouped_accuracy(rows: DataFrame, mode: str, kind: str, ok: Column, ms: Column) -> DataFrame:
    """Accuracy and mean time by mode, by kind and by both, from one pass over the rows."""
    base = rows.groupBy(mode, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("hits"), F.sum(ms).alias("ms"))
    sets = base.groupingSets([[mode], [kind], [mode, kind]], mode, kind).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("ms").alias("ms"))
    return sets.select(F.col(mode).alias("mode"), F.col(kind).alias("kind"), "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(F.col("ms"), F.col("n")).alias("mean_ms"))


def running_pair_mean(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The step summary's mean, (mean so far + next) / 2 in order; one short ordered list per key."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("s"))
    xs = F.transform("s", lambda x: x[value].cast("double"))
    mean = F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.element_at(xs, 1), lambda a, x: (a + x) / 2)
    return listed.select(key, F.size("s").alias("n"), mean.alias("running_mean"))


def mean_of_group_means(rows: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Mean over inner groups of their means; NaN counts as missing."""
    clean = F.when(F.isnan(value), None).otherwise(value)
    inner_means = rows.groupBy(outer, inner).agg(F.avg(clean).alias("m"))
    return inner_means.groupBy(outer).agg(F.avg("m").alias("score"))


def request_metrics(rows: DataFrame, path: str, status: Column, ms: Column) -> DataFrame:
    """Count, errors, mean and largest time per endpoint."""
    return rows.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.count_if(status >= 400).alias("errors"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


def last_n(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest rows of each session."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def quota(rows: DataFrame, label: str, order: Sequence[str], per_label: int, total: int) -> DataFrame:
    """The first ``per_label`` rows of each label, then the first ``total`` of all."""
    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("__n") <= per_label).drop("__n")
    return kept.orderBy(*order).limit(total)


def abort_after_empty(rows: DataFrame, key: str, order: str, empty: Column, streak: int = 3) -> DataFrame:
    """Rows up to and including the first run of ``streak`` empty ones, per key."""
    w = Window.partitionBy(key).orderBy(order)
    islands = rows.withColumn("__e", empty.cast("int")).withColumn("__g", F.sum(1 - empty.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("__e").over(Window.partitionBy(key, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    islands = islands.withColumn("__run", run)
    stop = islands.where(F.col("__run") == streak).groupBy(key).agg(F.min(order).alias("__stop"))
    return islands.join(stop, key, "left").where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__e", "__g", "__run", "__stop")


def best_attempt(rows: DataFrame, key: str) -> DataFrame:
    """attempts(exact, anchors, best_rank, attempt): most exact, then most anchors, then best rank, then first."""
    return rows.groupBy(key).agg(F.max_by("attempt", F.struct(F.col("exact").cast("int"), F.col("anchors"), -F.col("best_rank"), -F.col("attempt"))).alias("attempt"))


def document_type(hints: Column, paper: Sequence[str], technical: Sequence[str], medical: Sequence[str]) -> Column:
    """The vote of hint words; medical wins ties, then paper over technical."""
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(hints, w)))
    p, t, m = hits(paper), hits(technical), hits(medical)
    return F.when((m >= F.greatest(p, t)) & (m > 0), "medical").when((p > t) & (p > 0), "paper").when(t > 0, "technical").otherwise("generic")
