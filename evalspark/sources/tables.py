"""Reading and writing benchmark, prediction and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import numbers as N
from evalspark.functions import text as T
from evalspark.sources.delimited import read_delimited

_DELIMITED = {"csv": ",", "tsv": "\t"}


def suffix_of(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: ST.StructType | str | None = None) -> DataFrame:
    """Read csv, tsv, json (one document), jsonl, parquet or orc, chosen by ending.

    Delimited text is split over tasks, line breaks inside quotes or not; without a schema its columns are strings.  A json document
    is one value, which one task reads; give jsonl for more.
    """
    fmt = fmt or suffix_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt in _DELIMITED:
        return read_delimited(spark, path, _DELIMITED[fmt], schema)
    if fmt == "json":
        return reader.json(path, multiLine=True)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt in ("parquet", "orc"):
        return reader.format(fmt).load(path)
    raise ValueError(f"no reader for {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str | None = None, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write by ending; delimited text is quoted throughout."""
    fmt = fmt or suffix_of(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in _DELIMITED:
        # Texts are written as they are: Spark trims them by default.
        writer.csv(path, sep=_DELIMITED[fmt], header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt in ("parquet", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"no writer for {fmt!r}")


def parquet_to_tsv(spark: SparkSession, source: str, target: str) -> None:
    write_table(read_table(spark, source, "parquet"), target, "tsv")


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per model, data set and variant (frame count, packing, subtitles)."""
    with_variant = df if "variant" in df.columns else df.withColumn("variant", F.lit("default"))
    write_table(with_variant, path, "parquet", ["model", "dataset", "variant"], mode)


def run_variant(frames: Column | None = None, pack: Column | None = None, subtitles: Column | None = None) -> Column:
    """Variant name of a video run, such as ``8frame_pack_subs``."""
    parts = []
    if frames is not None:
        parts.append(F.concat(frames.cast("string"), F.lit("frame")))
    if pack is not None:
        parts.append(F.when(pack, "pack").otherwise("nopack"))
    if subtitles is not None:
        parts.append(F.when(subtitles, "subs").otherwise("nosubs"))
    return F.concat_ws("_", *parts) if parts else F.lit("default")


def canonical_headers(df: DataFrame) -> DataFrame:
    """Lower-case every column name except single capital letters."""
    return df.toDF(*[c if len(c) == 1 and c in K.LETTERS else c.lower() for c in df.columns])


def integer_index(df: DataFrame, column: str = "index") -> bool:
    """True when every index reads as a whole number (one aggregate)."""
    text = F.col(column).cast("string")
    return bool(df.agg(F.coalesce(F.bool_and(N.parse_int(text).isNotNull()), F.lit(False)).alias("ok")).first()["ok"])


def typed_index(df: DataFrame, column: str = "index", integer: bool | None = None) -> DataFrame:
    """Index as ``bigint`` when all of it is whole numbers, else as text."""
    integer = integer_index(df, column) if integer is None else integer
    text = F.col(column).cast("string")
    return df.withColumn(column, N.parse_int(text) if integer else text)


def with_images(df: DataFrame) -> DataFrame:
    """Drop rows without an image where the table has an image column."""
    return df.where(F.col("image").isNotNull()) if "image" in df.columns else df


def image_source(df: DataFrame) -> Column:
    """Where prompts take images from: payload rows by their index, else the path column."""
    if "image" in df.columns:
        return F.array(F.concat(F.col("index").cast("string"), F.lit(".jpg")))
    return T.to_list("image_path")


def check_md5(content: DataFrame, expected: DataFrame, keys: Sequence[str], payload: str = "content") -> DataFrame:
    """Rows whose digest differs from the expected one, with both digests."""
    digests = content.select(*keys, F.md5(F.col(payload).cast("binary")).alias("digest"))
    return digests.join(expected.select(*keys, "expected"), list(keys)).where(~F.col("digest").eqNullSafe(F.col("expected")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """md5 of every file under a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("digest"), "length")


def missing_media(table: DataFrame, files: DataFrame, path: str = "video_path") -> DataFrame:
    """Rows whose media file is not in the listing."""
    return table.join(files.select(F.col("path").alias(path)), path, "left_anti")


def check_submission(df: DataFrame) -> DataFrame:
    """Required columns that are missing, as rows ``(column, message)``."""
    have = canonical_headers(df).columns
    absent = [c for c in ("index", "prediction", "A", "B", "C", "D") if c not in have]
    rows = [(c, f"the table should have a column named `{c}`") for c in absent]
    return df.sparkSession.createDataFrame(rows, "column string, message string")


def guess_dataset(df: DataFrame, by: Sequence[str] = (), small: int = 2500) -> DataFrame:
    """Which of four benchmark families a submission looks like, by question language and size."""
    cn = T.has_cjk("question").cast("int")
    stats = df.groupBy(*by).agg(F.avg(cn).alias("cn_ratio"), F.count(F.lit(1)).alias("n"))
    chinese = F.col("cn_ratio") > 0.5
    if "l2-category" in df.columns:
        guess = F.when(chinese, "general_cn").otherwise("general_en")
    else:
        guess = (
            F.when((F.col("n") < small) & chinese, "culture_cn").when(F.col("n") < small, "unknown")
            .when(chinese, "general_cn").otherwise("general_en")
        )
    return stats.withColumn("guess", guess)


def submission_options(df: DataFrame, options: dict[str, str], key: str = "id") -> DataFrame:
    """``id, answer``: the inferred option of questions with options, the raw text of open ones."""
    letter = F.coalesce(A.infer_option("prediction", options), F.lit("false"))
    return df.select(key, F.when(F.col("A").isNotNull(), letter).otherwise(F.col("prediction")).alias("answer"))


def submission_table(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """Input rows with ``opt`` (Z when undecided) and ``log``."""
    opt = A.infer_option("prediction", options)
    log = F.when(opt.isNull(), K.NO_JUDGE_LOG).otherwise(T.as_text("prediction"))
    return df.withColumns({"opt": F.coalesce(opt, F.lit("Z")), "log": log})
