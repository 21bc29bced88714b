"""Reports across runs: leaderboard, failures, reshaping and radar ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T
from evalspark.plans import grouping as G


@dataclass(frozen=True)
class Metric:
    """One leaderboard column: report rows whose data set, split and key match, times ``scale``, summed."""

    name: str
    dataset: str
    key: str = "Overall"
    split: str | None = None
    scale: float = 1.0


def leaderboard(reports: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """One row per model, one column per metric (sorted); NULL where a model has no report."""
    split = F.col("split") if "split" in reports.columns else F.lit(None).cast("string")
    totals = []
    for name in sorted({m.name for m in metrics}):
        value = F.lit(None).cast("double")
        for m in (m for m in metrics if m.name == name):
            test = (F.col("dataset") == m.dataset) & (F.col("key") == m.key)
            if m.split is not None:
                test = test & (split == m.split)
            value = F.when(test, F.col("score") * m.scale).otherwise(value)
        totals.append(F.sum(value).alias(name))
    return reports.groupBy("model").agg(*totals)


# Judge log checks per data set family: which column shows a failed judge call.
def judge_failed(dataset: Column) -> Column:
    log, res = T.as_text("log", ""), T.as_text("res", "")
    return (
        F.when(F.contains(dataset, F.lit("MMVet")), F.contains(log, F.lit("All 5 retries failed.")))
        .when(F.contains(dataset, F.lit("MathVista")), F.contains(res, F.lit(K.FAIL_MESSAGE)))
        .when(dataset == "LLaVABench", F.col("gpt4_score") == -1)
        .otherwise(F.contains(log, F.lit(K.FAIL_MESSAGE)))
    )


def failure_scan(df: DataFrame, by: Sequence[str] = ("model", "dataset"), judged: bool = False) -> DataFrame:
    """Failed predictions (and judge calls) per run."""
    aggregates = [F.count_if(T.is_failure("prediction")).alias("failed"), F.count(F.lit(1)).alias("total")]
    if judged:
        aggregates.append(F.count_if(judge_failed(F.col("dataset"))).alias("judge_failed"))
    return df.groupBy(*by).agg(*aggregates).withColumn("failed_pct", F.col("failed") / F.col("total") * 100)


def reshape_accuracy(report: DataFrame, splits: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long accuracy report as one row per key and one upper-case column per split, in percent."""
    cells = [F.max(F.when(F.col("split") == s, F.col("score") * 100)).alias(s.upper()) for s in splits]
    return report.groupBy(*by, F.col("key").alias("category")).agg(*cells)


def radar_ranges(scores: DataFrame, metric: str = "metric", value: str = "score") -> DataFrame:
    """Every score on a 0-100 scale of one common width (the widest range plus a quarter), capped at 100."""
    spans = scores.groupBy(metric).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.max(F.col("hi") - F.col("lo")).over(Window.partitionBy(F.lit(1))) * 1.25
    ranged = spans.withColumn("width", width)
    mid = (F.col("lo") + F.col("hi")) / 2
    low = F.when(mid + F.col("width") / 2 < 100, mid - F.col("width") / 2).otherwise(100 - F.col("width"))
    ranges = ranged.select(metric, low.alias("range_low"), (low + F.col("width")).alias("range_high"), "width")
    return scores.join(ranges, metric).withColumn("radar", F.try_divide(F.col(value) - F.col("range_low"), F.col("width")) * 100).drop("width")


def attach_pack_answers(questions: DataFrame, packs: DataFrame, by: Sequence[str] = ("video",)) -> DataFrame:
    """Questions with their answer from the parsed map of their video's pack, NULL when absent."""
    joined = questions.join(packs.select(*by, "answers"), list(by), "left")
    return joined.withColumn("prediction", F.try_element_at("answers", F.col("index").cast("string"))).drop("answers")


def pack_statistics(packs: DataFrame, questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of failed, read and unreadable packs and of questions with and without an answer."""
    failed = T.is_failure("reply")
    pack_counts = packs.groupBy(*by).agg(
        F.count_if(failed).alias("GEN_FAIL"), F.count_if(~failed & F.col("answers").isNotNull()).alias("PARSE_OK"),
        F.count_if(~failed & F.col("answers").isNull()).alias("PARSE_FAIL"),
    )
    question_counts = questions.groupBy(*by).agg(
        F.count("prediction").alias("VALIDQ"), F.count_if(F.col("prediction").isNull()).alias("INVALIDQ")
    )
    return G.merge_measures([pack_counts, question_counts], by)
