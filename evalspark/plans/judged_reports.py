"""Reports on judged scores: capabilities, pairs, dialogues, multi-label videos, duration cube, task board."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T
from evalspark.plans import grouping as G

RUN = ("model", "dataset")


def capability(df: DataFrame, by: Sequence[str] = RUN, capabilities: Sequence[str] = tuple(K.CAPABILITIES)) -> DataFrame:
    """Total and mean score in percent per capability named in the category, and per exact combination."""
    sums = {"total": F.col("score").cast("double"), "tot": F.lit(1).cast("bigint")}
    partial = G.partial_sums(df, [*by, "category"], sums)
    named = F.array_compact(F.array(*[F.when(F.contains(F.col("category"), F.lit(c)), F.lit(c)) for c in capabilities]))
    single = F.transform(named, lambda c: F.struct(F.lit("capability").alias("level"), c.alias("key")))
    rest = F.array(
        F.struct(F.lit("combination").alias("level"), F.replace(F.col("category"), F.lit(","), F.lit("_")).alias("key")),
        F.struct(F.lit("overall").alias("level"), F.lit(G.OVERALL).alias("key")),
    )
    rows = partial.withColumn("_e", F.explode(F.concat(single, rest)))
    totals = rows.groupBy(*by, "_e.level", "_e.key").agg(F.sum("tot").alias("tot"), F.sum("total").alias("total"))
    return totals.select(*by, "level", "key", "tot", (F.col("total") / F.col("tot") * 100).alias("acc"))


def relative_score(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Mean score relative to the mean baseline score, and both times ten; overall and per category."""
    sums = {"s": F.col("score").cast("double"), "g": F.col("gpt4_score").cast("double"), "n": F.lit(1).cast("bigint")}
    totals = G.level_sums(df, by, {"overall": None, "category": "category"}, sums)
    own, base = F.col("s") / F.col("n"), F.col("g") / F.col("n")
    return totals.select(
        *by, "level", "key", "n", (own / base * 100).alias("relative"), (own * 10).alias("own_score"), (base * 10).alias("base_score")
    )


def dialogue_dimensions(df: DataFrame, by: Sequence[str] = RUN, dims: str = "dims") -> DataFrame:
    """Per dimension: summed score over all turns and over turns with a readable score, times ten."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, d in enumerate(K.DIALOGUE_DIMENSIONS):
        value = F.try_element_at(F.col(dims), F.lit(d))
        aggregates += [F.sum(value).alias(f"s{i}"), F.count(value).alias(f"v{i}")]
    totals = df.groupBy(*by).agg(*aggregates)
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"s{i}").alias("s"), F.col(f"v{i}").alias("valid"))
        for i, d in enumerate(K.DIALOGUE_DIMENSIONS)
    ])
    rows = totals.select(*by, "n", F.explode(entries).alias("_e")).select(*by, "n", "_e.*")
    return rows.select(
        *by, "dimension", "n", "valid", (F.coalesce("s", F.lit(0)) / F.col("n") * 10).alias("all_score"),
        F.try_divide(F.col("s") * 10.0, F.col("valid")).alias("valid_score"),
    )


def _label_groups() -> dict[str, list[str]]:
    groups = dict(K.VIDEO_LABEL_GROUPS)
    groups |= {name: [x for g in parts for x in K.VIDEO_LABEL_GROUPS[g]] for name, parts in K.VIDEO_SUPER_GROUPS.items()}
    return groups


def multi_label(df: DataFrame, by: Sequence[str] = RUN, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Mean score per label and per label group (a row counts once per group).

    ``all_score`` counts failed rows (below 0) as 0, ``valid_score`` leaves them out.
    """
    groups = _label_groups() if groups is None else groups
    score = F.col("score")
    partial = G.partial_sums(df, [*by, "dimensions"], {
        "n": F.lit(1).cast("bigint"), "total": F.greatest(score, F.lit(0)).cast("double"), "valid": (score >= 0).cast("bigint"),
    })
    labels = T.to_list("dimensions")
    staged = partial.withColumn("_labels", labels)
    coarse = F.array_compact(F.array(*[
        F.when(F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in members])),
               F.struct(F.lit("coarse").alias("level"), F.lit(name).alias("key")))
        for name, members in groups.items()
    ]))
    fine = F.transform("_labels", lambda x: F.struct(F.lit("fine").alias("level"), x.alias("key")))
    rows = staged.withColumn("_e", F.explode(F.concat(fine, coarse)))
    totals = rows.groupBy(*by, "_e.level", "_e.key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("valid").alias("valid"))
    return totals.select(
        *by, "level", "key", "n", "valid", (F.col("total") / F.col("n")).alias("all_score"),
        F.try_divide("total", "valid").alias("valid_score"),
    )


def duration_cube(df: DataFrame, by: Sequence[str] = RUN, fill: bool = False) -> DataFrame:
    """Mean of scores >= 0 per duration (and overall) by domain, sub-category and task type.

    ``fill`` adds the empty cells of the fixed dimension lists.
    """
    sums = {"total": F.when(F.col("score") >= 0, F.col("score")).cast("double"), "n": (F.col("score") >= 0).cast("bigint")}
    dims = ["domain", "sub_category", "task_type"]
    partial = G.partial_sums(df, [*by, "duration", *dims], sums)
    both = partial.withColumn("duration", F.explode(F.array("duration", F.lit("overall"))))
    totals = G.unfold_levels(both, [*by, "duration"], {"overall": None, **{d: d for d in dims}}, ["total", "n"])
    cube = totals.select(*by, "duration", "level", "key", "n", F.try_divide("total", "n").alias("score"))
    if not fill:
        return cube
    keys = [("overall", G.OVERALL)] + [("domain", x) for x in K.DOMAINS]
    keys += [("sub_category", x) for x in K.SUB_CATEGORIES] + [("task_type", x) for x in K.VIDEO_TASK_TYPES]
    cells = [(d, lv, k) for d in [*K.DURATIONS, "overall"] for lv, k in keys]
    names = [*by, "duration", "level", "key"]
    grid = G.constant_rows(df, by, cells, ["duration", "level", "key"])
    return grid.join(cube, names, "full").select(*names, F.coalesce("n", F.lit(0)).alias("n"), "score")


def task_board(df: DataFrame, by: Sequence[str] = RUN, strict: bool = False) -> DataFrame:
    """Hits, total and percent per task and overall.  Failed rows (-1) count as hits unless ``strict``."""
    hit = (F.col("score") > 0) if strict else (F.col("score") != 0)
    sums = {"hits": hit.cast("bigint"), "total": F.lit(1).cast("bigint")}
    totals = G.level_sums(df, by, {"overall": None, "task": "task_type"}, sums)
    return totals.select(*by, "level", "key", "hits", "total", (F.col("hits") / F.col("total") * 100).alias("pct"))
