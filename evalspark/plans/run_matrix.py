"""All data sets of all families in one pass: rows are scored by the rules of their family and summed by one grouped aggregate.

:func:`evalspark.plans.evaluate.evaluate_runs` reads its table once for each family.  Here the table is read once: each family's scorer sees the rows of
its own data sets and nothing (NULL) of the others, its measures become tagged values of the row, and the values of all families are
reduced to the finest groups before levels are unfolded.  Families are those whose report is a mean of row measures; the others keep their own plans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark import schema
from evalspark.operators import scorers as SC
from evalspark.plans import grouping as G

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Family:
    """A scorer that adds columns, which of them count, by what they are multiplied, and which levels are reported besides the overall one.

    ``inputs``: columns under the names that the scorer reads, where these are not the table's own.
    """

    scorer: Scorer
    measures: tuple[str, ...] = ("hit",)
    scale: float = 1.0
    levels: tuple[str, ...] = ("category",)
    inputs: Mapping[str, str] = field(default_factory=dict)


def _choices(df: DataFrame) -> DataFrame:
    return SC.score_options(df.withColumn("gt", F.col("answer")), {c: c for c in K.LETTERS if c in df.columns})


def _vqa(kind: str) -> Family:
    return Family(lambda df: SC.score_vqa(df, kind), scale=100.0)


BOTH = ("category", "l2_category")
FAMILIES: dict[str, Family] = {
    "choice": Family(_choices, levels=BOTH),
    "real_world": Family(SC.score_real_world, levels=BOTH),
    "video_choice": Family(SC.score_video_choice, ("score",), levels=BOTH),
    "yes_no": Family(SC.score_yes_no, ("score",), 100.0, BOTH),
    "vqa_consensus": _vqa("consensus"),
    "vqa_anls": _vqa("anls"),
    "vqa_relaxed": _vqa("relaxed"),
    "vqa_exact": _vqa("exact"),
    "containment": Family(SC.score_containment, scale=100.0),
    "table_truth": Family(SC.score_table_truth, ("score",)),
    "table_denotation": Family(SC.score_table_denotation, ("score",)),
    "table_financial": Family(SC.score_table_financial, ("exact_score", "score")),
    "document_anls": Family(SC.score_document_anls, ("score",), inputs={"pred": "prediction"}),
    "slides": Family(SC.score_slides, ("anls", "em", "f1"), inputs={"pred": "prediction"}),
    "judged_unit": Family(SC.score_judged_unit, ("score",)),
    "judged_integer": Family(SC.score_judged_integer, ("score",)),
}
_LEVELS = ("category", "l2_category", "split")


def row_measures(predictions: DataFrame, datasets: DataFrame, families: Mapping[str, Family] = FAMILIES) -> DataFrame:
    """``model, dataset, family, measure, value`` and the level columns, one row per row and measure of its family.

    ``datasets``: ``dataset, family``, one row per data set; rows of other data sets are left out.
    """
    known = {r["family"] for r in datasets.select("family").distinct().collect()}  # at most one per family
    used = {name: families[name] for name in sorted(known)}
    tagged = predictions.join(F.broadcast(datasets.select("dataset", "family")), "dataset")
    level = [c for c in _LEVELS if c in predictions.columns]
    columns = [c for c in predictions.columns if c not in ("model", "dataset")]
    rows = tagged.select("model", "dataset", "family", F.struct(*columns).alias("_in"))
    held = list(rows.columns)
    for name, family in used.items():
        own = F.col("family") == name
        read = {**{c: c for c in columns}, **family.inputs}
        shown = rows.select(*held, *[F.when(own, F.col("_in")[c]).alias(shown_as) for shown_as, c in read.items()])
        scored = family.scorer(shown)
        # Asked for in a branch, so that a measure is not computed for the rows of other families.
        rows = scored.select(*held, *[F.when(own, F.col(m).cast("double")).alias(f"{name}.{m}") for m in family.measures])
        held = [f"`{c}`" for c in rows.columns]
    value = lambda name, m: F.struct(F.lit(m).alias("measure"), F.col(f"`{name}.{m}`").alias("value"))
    values: Column | None = None
    for name, family in used.items():
        entry = F.array(*[value(name, m) for m in family.measures])
        values = F.when(F.col("family") == name, entry) if values is None else values.when(F.col("family") == name, entry)
    return rows.select("model", "dataset", "family", *[F.col("_in")[c].alias(c) for c in level], F.explode(values).alias("_v")).select(
        "model", "dataset", "family", *level, "_v.measure", "_v.value")


def evaluate_all(predictions: DataFrame, datasets: DataFrame, families: Mapping[str, Family] = FAMILIES) -> DataFrame:
    """``model, dataset, family, judge, measure, level, key, n, score`` of all runs; one read of the table and one grouped aggregate.

    ``datasets``: ``dataset, family`` and the task ``kind``; the judge of a data set follows from its name and kind (NULL where none is asked).
    """
    values = row_measures(predictions, datasets, families)
    level = [c for c in _LEVELS if c in values.columns]
    by = ["model", "dataset", "family", "measure"]
    partial = G.partial_sums(values, [*by, *level], {"total": F.col("value"), "n": F.col("value").isNotNull().cast("bigint")})
    shown = {c: [name for name, f in families.items() if c in f.levels] for c in level}
    keys = {c: F.when(F.col("family").isin(names), F.col(c)) for c, names in shown.items() if names}
    sums = G.unfold_levels(partial, by, {"overall": None, **keys}, ["total", "n"])
    scale = F.create_map(*[F.lit(x) for name, f in families.items() for x in (name, f.scale)])
    score = F.try_divide("total", "n") * F.element_at(scale, F.col("family"))
    judges = datasets.select("dataset", schema.judge_for(F.col("dataset"), F.col("kind")).alias("judge"))
    report = sums.select("model", "dataset", "family", "measure", "level", "key", "n", score.alias("score"))
    return report.join(F.broadcast(judges), "dataset").select("model", "dataset", "family", "judge", "measure", "level", "key", "n", "score")
