"""Session helpers: settings worth having for these jobs, and where intermediate tables may be written."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def builder(app: str = "evalspark", **settings: str):
    b = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        b = b.config(key, value)
    return b


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without; it gets a new folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    For results that must not be computed twice, such as replies of a model or judge; the table outlives
    lost executors.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove a table of :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    free(spark)


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of jobs that have ended; it does so when the driver's JVM collects what held them."""
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per application; they need no path of the driver."""
    # Whole texts in batches of this many rows fit a worker.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SETTINGS["spark.sql.execution.arrow.maxRecordsPerBatch"])
    context = spark.sparkContext
    if getattr(context, "_evalspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="evalspark-"), "evalspark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._evalspark_shipped = True
