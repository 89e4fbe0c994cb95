"""Reading the fixture tables and picking columns safely."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below ``sf_dir``, always through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def plain_scan(docs: DataFrame) -> bool:
    """Is ``docs`` one file scan with nothing but projections and filters on top?"""
    node = docs._jdf.queryExecution().analyzed()
    while True:
        name = node.getClass().getSimpleName()
        if name == "LogicalRelation":
            return True
        if name not in ("Project", "Filter", "SubqueryAlias") or node.children().size() != 1:
            return False
        node = node.children().head()


def with_places(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` with __file and __at, which name a row the same way at every reading.

    They are a file's hash and the row's number in it; rows that don't come
    straight from files are written first.
    """
    place = F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")
    if plain_scan(docs):
        try:
            return docs.select("*", *place)
        except AnalysisException:  # a format without row numbers
            pass
    return materialize(docs, tag).select("*", *place)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column under a name that no operator makes, and {column: that name}.

    ``.toDF(*docs.columns)`` on the same columns in the same order undoes it.
    """
    names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows, so a worker holds few texts as objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
