"""Stored tables that are merged by key, bucket by bucket (SNK1-SNK5).

A table is Parquet partitioned by a hash bucket of its key, one file each.  A
merge reads only the buckets that an update falls into and writes only these, by
Spark's dynamic partition overwrite: new files are staged beside the table and
take the place of the old when the whole job has succeeded, so a failed merge
leaves the table as it was and untouched buckets keep their files.

Edge cases: a missing table is made by the first merge; no updates change
nothing; of several updates of a key the greatest by ``order`` wins, and it wins
over the stored row; null keys are keys; columns that only one side has are null
in the other's rows.  One merge runs at a time on a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import keep_last, upsert

BUCKET = "merge_bucket"


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows without the bucket."""
    return spark.read.parquet(path).drop(BUCKET)


def merge_into(path: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 64, skip: str | None = None) -> list[int]:
    """Merge ``updates`` into the table at ``path``; the buckets that were written.

    ``skip`` is a condition on updates that are left out (SNK3: passages without a
    vector).  ``buckets`` must be the same in every merge of a table.
    """
    spark = updates.sparkSession
    given = updates if skip is None else updates.where(~F.coalesce(F.expr(skip), F.lit(False)))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    latest = keep_last(given, list(keys), list(order))
    touched = sorted(r[0] for r in latest.select(bucket.alias("b")).distinct().collect())
    if not touched:
        return []
    try:
        stored = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        rows = upsert(stored, latest, list(keys), list(order))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = latest
    made = rows.withColumn(BUCKET, bucket).repartition(min(buckets, len(touched)), BUCKET)
    made.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched
