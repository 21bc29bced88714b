"""Evaluation of many models on many data sets in one job.

A :class:`BenchmarkSpec` says how one family of data sets is prompted, scored and reported; users add
their own.  :func:`evaluate_runs` takes one prediction table with ``model`` and ``dataset`` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import messages as M
from evalspark.functions import text as T
from evalspark.operators import circular as C
from evalspark.operators import scorers as SC
from evalspark.plans import answer_reports as AR
from evalspark.plans import choice_reports as CR
from evalspark.plans import judged_reports as JR

RUN = ("model", "dataset")
LONG = [*RUN, "split", "level", "key", "n", "score"]

Scorer = Callable[[DataFrame], DataFrame]
Report = Callable[[DataFrame], DataFrame]
Prompt = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class BenchmarkSpec:
    """One family of data sets: row scorer, report, and the message asked of a model."""

    scorer: Scorer
    report: Report
    prompt: Prompt | None = None


def _options(df: DataFrame) -> dict[str, str]:
    return {c: c for c in K.LETTERS if c in df.columns}


def _images(df: DataFrame) -> Column | None:
    return T.to_list("image_path") if "image_path" in df.columns else None


def _choice_prompt(df: DataFrame) -> Column:
    hint = "hint" if "hint" in df.columns else None
    return M.base_message(_images(df), M.mcq_text("question", _options(df), hint))


def _short_prompt(df: DataFrame) -> Column:
    return M.base_message(_images(df), F.concat("question", F.lit(K.SHORT_ANSWER_SUFFIX)))


def _plain_prompt(df: DataFrame) -> Column:
    return M.base_message(_images(df), "question")


def choice_scorer(last_letter: str | None = None, bilingual: bool = False, open_questions: bool = False) -> Scorer:
    """Multiple-choice scorer; ``last_letter`` reads the last answer tag first."""

    def score(df: DataFrame) -> DataFrame:
        rows = SC.open_questions_as_options(df) if open_questions else df
        gold = SC.gold_letter("answer") if open_questions else F.col("answer")
        text = T.as_text("prediction")
        if bilingual:
            text = A.last_bilingual_tag(text)
        elif last_letter is not None:
            text = A.last_option_tag(text, last_letter)
        return SC.score_options(rows.withColumns({"prediction": text, "gt": gold}), _options(rows))

    return score


def _circular(df: DataFrame) -> DataFrame:
    extra = [c for c in ("split", "category", "l2_category") if c in df.columns]
    return C.score_circular(df.withColumn("gt", F.col("answer")), _options(df), by=(*RUN, *extra))


def _accuracy(df: DataFrame) -> DataFrame:
    return CR.accuracy(
        df, RUN, "l2_category" if "l2_category" in df.columns else None, "category" if "category" in df.columns else None
    )


def _vqa(family: str) -> BenchmarkSpec:
    return BenchmarkSpec(lambda df: SC.score_vqa(df, family), AR.vqa, _short_prompt)


def _measure(report: Report, value: str) -> Report:
    return lambda df: report(df).withColumnRenamed(value, "score")


SPECS: dict[str, BenchmarkSpec] = {
    "choice": BenchmarkSpec(choice_scorer(), _accuracy, _choice_prompt),
    "choice_tagged": BenchmarkSpec(choice_scorer("D"), _accuracy, _choice_prompt),
    "choice_bilingual": BenchmarkSpec(choice_scorer(bilingual=True), _accuracy, _choice_prompt),
    "choice_open": BenchmarkSpec(choice_scorer("I", open_questions=True), _accuracy, _choice_prompt),
    "choice_macro": BenchmarkSpec(choice_scorer(), CR.macro_accuracy, _choice_prompt),
    "choice_circular": BenchmarkSpec(_circular, _accuracy, _choice_prompt),
    "yes_no": BenchmarkSpec(SC.score_yes_no, CR.yes_no_accuracy, _plain_prompt),
    "yes_no_pairs": BenchmarkSpec(SC.score_yes_no, CR.paired, _plain_prompt),
    "yes_no_f1": BenchmarkSpec(SC.score_yes_no, _measure(CR.f1_scores, "f1"), _plain_prompt),
    "yes_no_hallucination": BenchmarkSpec(SC.score_yes_no, _measure(CR.hallucination, "mean_acc"), _plain_prompt),
    "vqa_consensus": _vqa("consensus"),
    "vqa_anls": _vqa("anls"),
    "vqa_relaxed": _vqa("relaxed"),
    "vqa_exact": _vqa("exact"),
    "ocr": BenchmarkSpec(SC.score_ocr, AR.ocr_card, _short_prompt),
    "containment": BenchmarkSpec(SC.score_containment, AR.containment, _short_prompt),
    "maths_typed": BenchmarkSpec(SC.score_maths, _measure(AR.task_skill, "acc"), _plain_prompt),
    "maths_choices": BenchmarkSpec(SC.score_maths_expression, _measure(AR.subject, "acc"), _plain_prompt),
    "document": BenchmarkSpec(
        SC.score_document, lambda df: AR.documents(df).withColumnsRenamed({"category": "key", "num": "n", "avg_score": "score"}), _plain_prompt
    ),
    "video_choice": BenchmarkSpec(SC.score_video_choice, JR.duration_cube, _plain_prompt),
    "video_options": BenchmarkSpec(SC.score_video_options, _measure(JR.task_board, "pct"), _plain_prompt),
}


def to_long(report: DataFrame) -> DataFrame:
    """Any report as ``model, dataset, split, level, key, n, score``."""
    count = next((c for c in ("n", "tot", "total", "num") if c in report.columns), None)
    fill = {
        "split": F.col("duration") if "duration" in report.columns else F.lit("none"), "level": F.lit("overall"), "key": F.lit("Overall"),
        "n": F.lit(None).cast("bigint") if count is None else F.col(count).cast("bigint"),
    }
    columns = [(F.col(c) if c in report.columns else fill[c]).alias(c) for c in LONG if c not in ("n", "score")]
    return report.select(*columns, fill["n"].alias("n"), F.col("score").cast("double").alias("score"))


def evaluate(predictions: DataFrame, family: str | BenchmarkSpec) -> DataFrame:
    """Long report of one family; ``predictions`` carry answers, ``model`` and ``dataset``."""
    spec = SPECS[family] if isinstance(family, str) else family
    return to_long(spec.report(spec.scorer(predictions)))


def evaluate_runs(predictions: DataFrame, families: Mapping[str, str | BenchmarkSpec]) -> DataFrame:
    """One report over all models and data sets; ``families`` names the family of each data set.

    Data sets of one family are scored together, so the plan grows with the families in use, not with
    models or data sets; a partitioned table is read only where a family needs it.
    """
    groups: dict[str | BenchmarkSpec, list[str]] = {}
    for dataset, family in families.items():
        groups.setdefault(family, []).append(dataset)
    reports = [evaluate(predictions.where(F.col("dataset").isin(names)), family) for family, names in groups.items()]
    merged = reports[0]
    for report in reports[1:]:
        merged = merged.unionByName(report)
    return merged


def prompts(rows: DataFrame, family: str | BenchmarkSpec) -> DataFrame:
    """Rows with the ``message`` their family asks."""
    spec = SPECS[family] if isinstance(family, str) else family
    if spec.prompt is None:
        raise ValueError("this family has no prompt")
    return rows.withColumn("message", spec.prompt(rows))
