"""Lineage cuts that survive executor loss: Parquet tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship_package


#: Temporary folders of local applications that name no checkpoint folder.
_local: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (local tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _local[application]


def application_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if path not in _marked:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _marked.add(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a fresh scan of it.

    Unlike ``persist`` the result is not tied to executors, and unlike
    ``checkpoint`` it stays columnar, so later scans read only needed columns.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{application_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` whose rows are no longer needed."""
    root = shared_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if root.split("://")[-1].lstrip("/") in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)
