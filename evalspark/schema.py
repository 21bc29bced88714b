"""Column types of the input tables and the registry of data sets.

Tables use the superset schema below; absent columns are NULL.  What a table is for follows from its
columns (:func:`table_kind`), decided when the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
DIALOGUE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", MESSAGE)]))


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_RUN = _strings("model", "dataset")
_INDEX = T.StructField("index", T.LongType(), False)
_PREDICTION = _strings("prediction")

OPTIONS = tuple("ABCDEFGHIJKL")

SCHEMAS: dict[str, T.StructType] = {
    "mcq": T.StructType(
        [*_RUN, _INDEX, *_strings("question", "hint", *OPTIONS, "answer", "category", "l2-category", "split",
                                  "question_type", "cycle_category", "image", "image_path"), *_PREDICTION]
    ),
    "yes_no": T.StructType(
        [*_RUN, *_strings("index", "question", "answer", "category", "l2-category", "image_path"), *_PREDICTION]
    ),
    "vqa": T.StructType([*_RUN, _INDEX, *_strings("question", "answer", "split", "category", "image"), *_PREDICTION]),
    "maths": T.StructType(
        [*_RUN, _INDEX, *_strings("question", "question_type", "answer_type", "answer", "answer_option", "choices", "task",
                                  "category", "skills", "res", "log"), *_PREDICTION]
    ),
    "document": T.StructType(
        [*_RUN, _INDEX, *_strings("doc_id", "question", "answer", "pred", "answer_format", "evidence_sources",
                                  "evidence_pages", "image_path"), *_PREDICTION]
    ),
    "judged": T.StructType(
        [*_RUN, _INDEX, *_strings("category", "caption", "gpt4_ans", "dimensions"),
         T.StructField("gpt4_score", T.DoubleType()), T.StructField("score", T.DoubleType()), *_PREDICTION]
    ),
    "video": T.StructType(
        [*_RUN, _INDEX, *_strings("video", "video_path", "duration", "domain", "sub_category", "task_type",
                                  "subtitle_path", "question", "answer", "candidates", "prefix", "data_type"),
         T.StructField("bound", T.BooleanType()), T.StructField("start", T.DoubleType()),
         T.StructField("end", T.DoubleType()), *_PREDICTION]
    ),
    "subtitles": T.StructType(
        [*_strings("video"), T.StructField("pos", T.LongType()), T.StructField("start_ms", T.LongType()),
         T.StructField("end_ms", T.LongType()), *_strings("text")]
    ),
    "results": T.StructType(
        [*_RUN, _INDEX, T.StructField("hit", T.IntegerType()), T.StructField("score", T.DoubleType()), *_strings("opt", "log")]
    ),
    "turns": T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *_strings("role", "text")]
    ),
}


@dataclass(frozen=True)
class DatasetInfo:
    name: str
    kind: str
    modality: str = "IMAGE"


# Public benchmark names and what they ask for.  Users add their own rows.
REGISTRY: tuple[DatasetInfo, ...] = (
    DatasetInfo("AI2D_TEST", "MCQ"), DatasetInfo("ScienceQA_TEST", "MCQ"), DatasetInfo("MMStar", "MCQ"),
    DatasetInfo("MMMU_DEV_VAL", "MCQ"), DatasetInfo("RealWorldQA", "MCQ"), DatasetInfo("BLINK", "MCQ"),
    DatasetInfo("TextVQA_VAL", "VQA"), DatasetInfo("DocVQA_VAL", "VQA"), DatasetInfo("InfoVQA_VAL", "VQA"),
    DatasetInfo("ChartQA_TEST", "VQA"), DatasetInfo("OCRVQA_TEST", "VQA"), DatasetInfo("GQA_TestDev_Balanced", "VQA"),
    DatasetInfo("OCRBench", "VQA"), DatasetInfo("MathVista_MINI", "VQA"), DatasetInfo("MathVision", "VQA"),
    DatasetInfo("MMVet", "VQA"), DatasetInfo("MTVQA_TEST", "VQA"), DatasetInfo("TableVQABench", "VQA"),
    DatasetInfo("DUDE", "VQA"), DatasetInfo("SLIDEVQA", "VQA"), DatasetInfo("MME", "Y/N"),
    DatasetInfo("HallusionBench", "Y/N"), DatasetInfo("POPE", "Y/N"), DatasetInfo("COCO_VAL", "Caption"),
    DatasetInfo("MMDU", "MT"), DatasetInfo("Video-MME", "MCQ", "VIDEO"), DatasetInfo("MVBench", "MCQ", "VIDEO"),
)


def registry_table(spark: SparkSession, extra: Sequence[DatasetInfo] = ()) -> DataFrame:
    rows = [(d.name, d.kind, d.modality) for d in (*REGISTRY, *extra)]
    return spark.createDataFrame(rows, "dataset string, kind string, modality string")


def dataset_kind(df: DataFrame, registry: DataFrame, parts: dict[str, Sequence[str]] | None = None,
                 default: str = "MCQ") -> DataFrame:
    """Adds ``kind``: from the registry, from the parts of a combined set, by name, else the default."""
    known = registry.select("dataset", "kind")
    for whole, pieces in (parts or {}).items():
        agreed = known.where(F.col("dataset").isin(list(pieces))).groupBy().agg(
            F.when(F.min("kind") == F.max("kind"), F.min("kind")).alias("kind")
        )
        known = known.unionByName(agreed.select(F.lit(whole).alias("dataset"), "kind"))
    open_ended = F.contains(F.lower("dataset"), F.lit("openended"))
    fallback = F.when(open_ended, "VQA").otherwise(default)
    return df.join(known, "dataset", "left").withColumn("kind", F.coalesce("kind", fallback))


# Task kind and data set name -> judge model, first match wins (names are substrings).
JUDGE_RULES: tuple[tuple[tuple[str, ...], tuple[str, ...], str], ...] = (
    (("MCQ", "Y/N"), (), "chatgpt-0125"),
    ((), ("MMVet", "LLaVABench", "MMBench-Video"), "gpt-4-turbo"),
    ((), ("MathVista", "MathVerse", "MathVision", "DynaMath", "VL-RewardBench", "LogicVista", "MOAT"), "gpt-4o-mini"),
    ((), ("MMLongBench", "MMDU", "DUDE", "SLIDEVQA"), "gpt-4o"),
)


def judge_for(dataset: Column, kind: Column, rules: tuple[tuple[tuple[str, ...], tuple[str, ...], str], ...] = JUDGE_RULES) -> Column:
    """Judge name of a run by the first rule that fits, NULL when none is needed."""
    out = F.lit(None).cast("string")
    for kinds, names, judge in reversed(rules):
        test = kind.isin(list(kinds)) if kinds else F.lit(True)
        if names:
            named = F.lit(False)
            for n in names:
                named = named | F.contains(dataset, F.lit(n))
            test = test & named
        out = F.when(test, judge).otherwise(out)
    return out


def table_kind(columns: Sequence[str]) -> str:
    """Task of a custom table by its columns: ``MCQ``, ``TEXT_MCQ`` or ``VQA``."""
    if "question" not in [c.lower() for c in columns]:
        raise ValueError("a benchmark table needs a question column")
    if "A" in columns and "B" in columns:
        return "MCQ" if "image" in columns or "image_path" in columns else "TEXT_MCQ"
    return "VQA"
