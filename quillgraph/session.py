"""Session construction for local runs; on a cluster the caller passes its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, app: str = "quillgraph") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLGRAPH_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Local workers find it where the driver does, by PYTHONPATH or the working
    folder.  Workers of a cluster share neither with the driver, so it is sent
    to them as a zip file, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    paths = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    local = context.master == "local" or context.master.startswith("local[")
    if not (local and os.path.realpath(root) in paths):
        import atexit
        import shutil
        import tempfile

        folder = tempfile.mkdtemp(prefix="quillgraph-zip-")  # on the driver, which serves it to executors until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "quillgraph"), "zip", root, "quillgraph"))
    context._quillgraph_shipped = True
