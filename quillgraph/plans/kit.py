"""Registering queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inverted_index
from ..operators.inverted_index import TextIndex


class Book:
    """A module's queries; ``queries`` and ``oracle_sql`` are what the registry collects."""

    def __init__(self) -> None:
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def note(f):
            key = name or f.__name__
            if key in self._queries:
                raise ValueError(f"{key} is registered twice")
            self._queries[key] = f
            if sql:
                self._sql[key] = sql
            return f

        return note

    def queries(self) -> dict:
        return dict(self._queries)

    def oracle_sql(self) -> dict:
        return dict(self._sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column) -> Column:
    """``value`` to 6 places as the SQL twins round a double: by its product, which may lie just below a half that its digits show."""
    return F.round(value * F.lit(1e6), 0) / F.lit(1e6)


def dealt(df: DataFrame) -> DataFrame:
    """Rows for work that is heavy per row.

    A small table in few splits is dealt over the cores; one with as many splits
    as cores, as any large table has, is read as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt over the cores."""
    return dealt(table(spark, sf_dir, "documents"))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored inverted index of the documents, built by the first query that asks for it."""
    return inverted_index.shared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def made_of(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """A "(SELECT expressions FROM table)" text of the SQL twins as a DataFrame: the same rows for both engines."""
    inner = select[len("(SELECT ") : select.rindex(" FROM ")]
    name = select[select.rindex(" FROM ") + 6 :].rstrip(")")
    parts, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(inner):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            parts.append(inner[at:i])
            at = i + 1
    return table(spark, sf_dir, name).selectExpr(*parts, inner[at:])
