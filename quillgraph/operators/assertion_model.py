"""A learned assertion classifier behind the rules (U8, F18): hashed character n-grams and multinomial logistic regression.

Training is Spark's own: features are made by expressions and hashed where the
rows lie, gradients are summed over partitions as a tree, and the driver holds
one coefficient matrix (labels x ``FEATURES``) whatever the number of rows.

The entity is marked in its sentence; only what stands near it is read, as the
rules do.  A prediction takes the rules' word where they are sure of a label
other than affirmed, then the model's where it is sure, then the rules' again.

Edge cases: a null text or entity has the features of the empty string; an entity
that isn't in its text leaves it unmarked; a label that only some rows have is
learned; one label alone is always predicted; rows without a label aren't learned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from . import policy

FEATURES = 1 << 14
#: Characters on either side of the entity that are read, and the longest n-gram.
NEAR, LONGEST = 32, 4
OPEN, CLOSE = "\u0002", "\u0003"


def marked(text: Column, entity: Column) -> Column:
    """The text with marks around the entity's first occurrence, cut to what stands near it."""
    t, e = X.text_or_empty(text), X.text_or_empty(entity)
    at = F.call_function("instr", t, e)
    before = F.substr(t, F.greatest(at - NEAR, F.lit(1)), F.least(at - 1, F.lit(NEAR)))
    after = F.substr(t, at + F.length(e), F.lit(NEAR))
    return F.lower(F.when((at > 0) & (e != ""), F.concat(before, F.lit(OPEN), F.lit(CLOSE), after)).otherwise(F.left(t, F.lit(2 * NEAR))))


def grams(text: Column) -> Column:
    """All character n-grams up to ``LONGEST``; marks are characters like others, so they say on which side a cue stands."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(X.no_strings())
    return F.concat(*(of(n) for n in range(1, LONGEST + 1)))


def _features(rows: DataFrame, text_col: str, entity_col: str) -> DataFrame:
    near = rows.withColumn("__near", marked(F.col(text_col), F.col(entity_col)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__features").transform(near.withColumn("__grams", grams(F.col("__near")))).drop("__near", "__grams")


@dataclass
class AssertionModel:
    labels: list[str]
    model: LogisticRegressionModel | None

    def predict(self, rows: DataFrame, text_col: str, entity_col: str) -> DataFrame:
        """``rows`` with model_label and model_confidence."""
        if self.model is None:
            only = F.lit(self.labels[0] if self.labels else None).cast("string")
            return rows.withColumn("model_label", only).withColumn("model_confidence", F.when(only.isNotNull(), 1.0).otherwise(0.0))
        scored = self.model.transform(_features(rows, text_col, entity_col))
        names = F.array(*map(F.lit, self.labels))
        label = F.element_at(names, (F.col("__predicted") + 1).cast("int"))
        return scored.withColumn("model_label", label).withColumn("model_confidence", F.array_max(vector_to_array("__probability"))).drop("__features", "__raw", "__probability", "__predicted")


def fit(samples: DataFrame, text_col: str = "text", entity_col: str = "entity", label_col: str = "label", iterations: int = 60, ridge: float = 1e-4) -> AssertionModel:
    """A model of all labelled ``samples``."""
    rows = samples.where(F.col(label_col).isNotNull())
    labels = sorted(r[0] for r in rows.select(label_col).distinct().collect())  # the label set of the task, some six values
    if len(labels) < 2:
        return AssertionModel(labels, None)
    number = F.create_map(*(F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))))
    ready = _features(rows.select(text_col, entity_col, F.element_at(number, F.col(label_col)).alias("__label")), text_col, entity_col).select("__features", "__label")
    learner = LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__predicted", probabilityCol="__probability", rawPredictionCol="__raw", family="multinomial", regParam=ridge, maxIter=iterations, aggregationDepth=2)
    return AssertionModel(labels, learner.fit(ready))


def guarded(rows: DataFrame, model: AssertionModel, text_col: str = "text", entity_col: str = "entity", threshold: float = 0.75, cues: dict = L.ASSERTION_CUES) -> DataFrame:
    """``rows`` with label, confidence and labeler (rules or model), beside the model's own label."""
    scored = model.predict(rows, text_col, entity_col).withColumn("__rule", policy.classify_assertion(F.col(text_col), F.col(entity_col), cues))
    sure = (F.col("__rule.label") != "affirmed") & (F.col("__rule.confidence") >= threshold)
    taken = ~sure & (F.col("model_confidence") >= threshold)
    pick = lambda learned, rule: F.when(taken, learned).otherwise(rule)
    made = scored.withColumn("label_", pick(F.col("model_label"), F.col("__rule.label"))).withColumn("confidence", pick(F.col("model_confidence"), F.col("__rule.confidence"))).withColumn("labeler", pick(F.lit("model"), F.lit("rules")))
    return made.drop("label", "__rule").withColumnRenamed("label_", "label")


def accuracy(rows: DataFrame, model: AssertionModel, text_col: str = "text", entity_col: str = "entity", label_col: str = "label", **options) -> DataFrame:
    """(true_label, n, model_correct, guarded_correct): the model alone and behind the rules' guard, by true label."""
    given = rows.withColumnRenamed(label_col, "true_label")
    found = guarded(given, model, text_col, entity_col, **options)
    hit = lambda c: F.count_if(F.col(c) == F.col("true_label"))
    return found.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"), hit("model_label").alias("model_correct"), hit("label").alias("guarded_correct"))
