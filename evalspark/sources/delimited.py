"""Delimited text with line breaks inside quotes, read by many tasks.

Spark reads such a file in one task, because a line break may be text.  Here the file is read as lines, split like any text, and records are found from
the number of quotes: a line begins a record if an even number of quotes stands before it in its file.  Quotes are summed per split first,
one row each; the sums before a split say how it begins, and inside a split the lines are counted on.  A record that goes on in the next split is
put together by the number of its first line.  Records are then parsed one by one.

Lines are dealt by split, so one file of any size is read by as many tasks as it has splits.  Only a split and a record must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

QUOTE = '"'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, at, line, quotes``: lines in order of ``split`` and ``at`` inside each file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"), (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).cast("long").alias("quotes"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, number, record``: whole records, the first of each file (its header) included; ``split`` and ``number`` are those of the first line."""
    lines, place = numbered_lines(spark, path), ["file", "split"]
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(*place).agg(F.sum("quotes").alias("_q"))
    opened = sums.select(*place, F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*place).orderBy("at")
    counted = lines.join(opened, place).withColumn("_open", F.col("_before") + F.sum("quotes").over(inside) - F.col("quotes"))
    numbered = counted.withColumn("number", F.sum((F.col("_open") % 2 == 0).cast("long")).over(inside))
    # Lines at the head of a split that no start is before belong to the last record of the nearest split that has one.
    last = numbered.groupBy(*place).agg(F.max("number").alias("_n"))
    carried = F.last(F.when(F.col("_n") > 0, F.struct(F.col("split").alias("split"), F.col("_n").alias("number"))), ignorenulls=True).over(before)
    whose = numbered.join(last.select(*place, "_n", carried.alias("_last")), place)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    # All of this is dealt by split, so lines are shuffled once; only what stands at the ends of splits moves again.
    pieces = whose.groupBy(*place, "number").agg(joined.alias("record"), F.first("_n").alias("_n"), F.first("_last").alias("_last"))
    inner = pieces.where((F.col("number") > 0) & (F.col("number") < F.col("_n"))).select(*place, "number", "record")
    own = F.when(F.col("number") > 0, F.struct("split", "number")).otherwise(F.col("_last"))
    ends = pieces.where((F.col("number") == 0) | (F.col("number") == F.col("_n"))).select("file", own.alias("_r"), F.struct("split", "number", "record").alias("_p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["record"]), "\n")
    put = ends.groupBy("file", F.col("_r.split").alias("split"), F.col("_r.number").alias("number")).agg(whole.alias("record"))
    return inner.unionByName(put)


def read_delimited(spark: SparkSession, path: str, sep: str, schema: ST.StructType | str | None = None) -> DataFrame:
    """Rows of all files; every file begins with the same header.  Without a schema all columns are strings; with one its names must be the header's."""
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "lineSep": "\n"}
    names = spark.read.options(**options).csv(path, header=True).columns  # reads the first record only
    if schema is None:
        schema = ST.StructType([ST.StructField(c, ST.StringType()) for c in names])
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if [f.name.lower() for f in schema] != [c.lower() for c in names]:
        raise ValueError(f"the header has {names}, the schema {schema.names}")
    found = records(spark, path)
    body = found.where(~((F.col("split") == 0) & (F.col("number") == 1)) & (F.col("record") != ""))
    parsed: Column = F.from_csv("record", _ddl(schema), options)
    return body.select(parsed.alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in schema])


def _ddl(schema: ST.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
