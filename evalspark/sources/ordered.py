"""Tables in order over many files: written by ranges of the key, sorted inside, with a manifest that proves the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.operators.order import join_groups


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Write Parquet files whose rows are in order of ``keys`` inside and from file to file, and their manifest; returns the manifest.

    Rows are dealt by sampled ranges, so files are about equal and no task orders the table.  ``files``: how many at most; the session's shuffle partitions by default.
    Equal keys are in one file.  The manifest has one row per file: ``file, n, least, greatest``.
    """
    spark = df.sparkSession
    number = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(number, *keys).sortWithinPartitions(*keys).write.parquet(path)
    key = F.struct(*keys)
    back = spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("file"), key.alias("k"))
    back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.max("k").alias("greatest")).write.parquet(manifest_path(path))
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, least, greatest, first_row, in_order``: where each file's rows begin, and whether its keys come after those of the file before.

    One row per file is ordered, whatever the table holds.
    """
    files = spark.read.parquet(manifest_path(path))
    order = Window.orderBy("least")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumns({
        "first_row": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "in_order": F.coalesce(F.lag("greatest").over(order) < F.col("least"), F.lit(True)),
    })


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``row_no``, their place in the whole order from 0: the file's first row and the row's place in the file; nothing is sorted again."""
    listed = manifest(spark, path)
    wrong = listed.where(~F.col("in_order")).select("file").take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['file']} is out of order")
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_at"))
    placed = join_groups(rows, listed.select("file", "first_row"), ["file"])
    return placed.withColumn("row_no", F.col("first_row") + F.col("_at")).drop("file", "_at", "first_row")
