"""Reports on multiple-choice and yes/no scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark import session
from evalspark.functions import answers as A
from evalspark.functions import text as T
from evalspark.plans import grouping as G

RUN = ("model", "dataset")


def with_split(df: DataFrame) -> DataFrame:
    """Rows without a split belong to ``none``."""
    return df.withColumn("split", F.coalesce("split", F.lit("none")) if "split" in df.columns else F.lit("none"))


def accuracy(df: DataFrame, by: Sequence[str] = RUN, l2: str | None = "l2_category", category: str | None = "category") -> DataFrame:
    """Mean hit per split: overall, per ability group and per ability (short names)."""
    levels: dict[str, str | None] = {"overall": None}
    if l2:
        levels["l2_category"] = l2
    if category:
        levels["category"] = category
    return G.rename_keys(G.level_means(with_split(df), [*by, "split"], levels, "hit"), K.ABILITY_SHORT_NAMES)


def accuracy_by(df: DataFrame, columns: Sequence[str], by: Sequence[str] = RUN) -> DataFrame:
    """Mean hit per split: overall and per value of each chosen column."""
    return G.level_means(with_split(df), [*by, "split"], {"overall": None, **{c: c for c in columns}}, "hit")


def macro_accuracy(df: DataFrame, by: Sequence[str] = RUN, l2: str = "l2_category", category: str = "category") -> DataFrame:
    """Accuracy with an ``ALL`` split, where an ability group is the mean of its categories' means.

    A group is NULL in a split in which one of its categories has no rows.  The finest sums are used four
    times, so they are written once (a small table) instead of scoring all rows again.
    """
    sums = {"total": F.col("hit").cast("double"), "n": F.lit(1).cast("bigint")}
    partial = session.materialise(G.partial_sums(with_split(df), [*by, "split", l2, category], sums), "finest-sums")
    both = partial.withColumn("split", F.explode(F.array("split", F.lit("ALL"))))
    micro = G.unfold_levels(both, [*by, "split"], {"overall": None, "category": category}, ["total", "n"])
    micro = micro.withColumn("score", F.col("total") / F.col("n"))
    pairs = partial.where(F.col(l2).isNotNull()).select(*by, F.col(l2).alias("l2"), F.col(category).alias("key")).distinct()
    sizes = pairs.groupBy(*by, "l2").agg(F.count(F.lit(1)).alias("members"))
    means = micro.where("level = 'category'").select(*by, "split", "key", "n", "score")
    macro = (
        pairs.join(means, [*by, "key"])
        .groupBy(*by, "l2", "split")
        .agg(F.sum("n").alias("n"), F.count("score").alias("found"), F.sum("score").alias("s"))
        .join(sizes, [*by, "l2"])
        .select(
            *by, "split", F.lit("l2_category").alias("level"), F.col("l2").alias("key"), "n",
            F.when(F.col("found") == F.col("members"), F.col("s") / F.col("members")).alias("score"),
        )
    )
    columns = [*by, "split", "level", "key", "n", "score"]
    return micro.select(*columns).unionByName(G.rename_keys(macro, K.TASK_GROUP_SHORT_NAMES))


def cycle_accuracy(df: DataFrame, by: Sequence[str] = RUN, cycle: str = "cycle_category", category: str = "category") -> DataFrame:
    """Mean hit per cycle and category, and their sum over cycles divided by the number of cycles."""
    per_cycle = G.level_means(df, [*by, cycle], {"overall": None, "category": category}, "hit")
    rows = per_cycle.select(
        *by, F.col(cycle).alias("cycle"), F.when(F.col("level") == "overall", "all").otherwise(F.col("key")).alias("type"), "score"
    )
    # From here on there is one row per cycle and type.
    both = rows.withColumn("cycle", F.explode(F.array("cycle", F.lit("Average"))))
    totals = both.groupBy(*by, "cycle", "type").agg(F.sum("score").alias("total"))
    is_average = F.col("cycle") == "Average"
    cycles = F.count_if(~is_average & (F.col("type") == "all")).over(Window.partitionBy(*by))
    return totals.select(*by, "cycle", "type", (F.col("total") / F.when(is_average, cycles).otherwise(1)).alias("score"))


def nested_accuracy(df: DataFrame, by: Sequence[str] = RUN, l2: str = "l2_category",
                    tasks: Sequence[str] | None = None, subtasks: Sequence[str] | None = None) -> DataFrame:
    """Micro-averages per task, subtask and folded category; negative scores are left out, empty cells are 0."""
    tasks = K.NESTED_TASKS if tasks is None else tasks
    subtasks = K.NESTED_SUBTASKS if subtasks is None else subtasks
    task, subtask, path = A.fold_category("category", l2)
    kept = df.where("score >= 0").select(*by, task.alias("task"), subtask.alias("subtask"), path.alias("path"), "score")
    partial = G.partial_sums(kept, [*by, "task", "subtask", "path"], {"total": F.col("score").cast("double"), "n": F.lit(1).cast("bigint")})
    # Each cell of the fixed grid gets an empty row; the table is small by now.
    none = F.lit(None).cast("string")
    grid = [
        F.struct(F.lit(t).alias("task"), F.lit(s).alias("subtask"), none.alias("path"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"))
        for t in tasks for s in subtasks
    ]
    cells = partial.select(*by, F.explode(F.array(F.struct("task", "subtask", "path", "total", "n"), *grid)).alias("_c")).select(*by, "_c.*")
    rolled = cells.groupingSets(
        [[*map(F.col, by), F.col("task"), F.col("subtask"), F.col("path")], [*map(F.col, by), F.col("task"), F.col("subtask")],
         [*map(F.col, by), F.col("task")], [*map(F.col, by)]],
        *by, "task", "subtask", "path",
    ).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"),
        (F.grouping("task") + F.grouping("subtask") + F.grouping("path")).alias("up"),
    )
    name = F.create_map(*[F.lit(x) for p in ((0, "category"), (1, "subtask"), (2, "task"), (3, "overall")) for x in p])
    found = rolled.select(*by, F.try_element_at(name, F.col("up").cast("int")).alias("level"), "task", "subtask", "path", "n",
                          F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("score"))
    return found.where((F.col("level") != "category") | F.col("path").isNotNull())


# ------------------------------------------------------------------ yes / no
def first_two(df: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """First two scores of every group in file order (``s1``, ``s2``; NULL when missing)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    kept = df.select(*by, pos, "score").withColumn("_r", rank).where("_r <= 2")
    return kept.groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("s1"),
                                 F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("s2"))


def paired(df: DataFrame, by: Sequence[str] = RUN, pos: str = "index", supers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per category: 100 x mean score + 100 x share of images with both questions right; super-category sums.

    ``n_unpaired`` counts images with fewer than two questions; they are left out of the pair share.
    """
    supers = K.PAIR_SUPER_CATEGORIES if supers is None else supers
    keys = [*by, "category"]
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("score").cast("double")).alias("single"))
    pairs = first_two(df, [*keys, "image_path"], pos).groupBy(*keys).agg(
        F.avg((F.col("s1") * F.col("s2")).cast("double")).alias("both"), F.count_if(F.col("s2").isNull()).alias("n_unpaired")
    )
    per_category = single.join(pairs, keys).withColumn(
        "score", F.col("single") * 100 + F.coalesce("both", F.lit(0.0)) * 100
    )
    group = F.lit(None).cast("string")
    for name, members in supers.items():
        group = F.when(F.col("category").isin(list(members)), name).otherwise(group)
    return G.unfold_levels(per_category, by, {"category": "category", "super": group}, ["n", "n_unpaired", "score"])


def hallucination(df: DataFrame, by: Sequence[str] = RUN, index: str = "index") -> DataFrame:
    """Share of right answers, of figures all right and of questions all right, overall and per slice."""
    rows = df.select(
        *by, "category", "l2_category", T.split_key(index, 3).alias("set_id"), T.split_key(index, 4).alias("figure_id"),
        T.split_key(index, 5).alias("question_id"), F.col("score").cast("int").alias("score"),
    )
    finest = rows.groupBy(*by, "category", "l2_category", "set_id", "figure_id", "question_id").agg(
        F.min("score").alias("worst"), F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")
    )
    slices = F.array(*[
        F.struct(F.lit(lv).alias("level"), k.cast("string").alias("key"))
        for lv, k in (("overall", F.lit(G.OVERALL)), ("category", F.col("category")), ("l2_category", F.col("l2_category")))
    ])
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_id").alias("id")) for p in ("figure", "question")])
    sliced = finest.withColumn("_s", F.explode(slices)).where(F.col("_s.key").isNotNull()).withColumn("_p", F.explode(parts))
    keys = [*by, "level", "key"]
    groups = sliced.groupBy(*by, "_s.level", "_s.key", "_p.part", "l2_category", "set_id", "_p.id").agg(
        F.min("worst").alias("worst"), F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    by_figure, by_question = F.col("part") == "figure", F.col("part") == "question"
    right = F.col("worst").cast("double")
    measures = groups.groupBy(*keys).agg(
        F.sum(F.when(by_figure, F.col("n"))).alias("n"),
        (F.sum(F.when(by_figure, F.col("total"))) / F.sum(F.when(by_figure, F.col("n"))) * 100).alias("aAcc"),
        (F.avg(F.when(by_figure, right)) * 100).alias("fAcc"),
        (F.avg(F.when(by_question, right)) * 100).alias("qAcc"),
    )
    return measures.withColumn("mean_acc", (F.col("aAcc") + F.col("fAcc") + F.col("qAcc")) / 3)


def f1_scores(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """F1, precision, recall and accuracy in percent; a row counts once per listed category, also overall."""
    gold, pred = F.col("answer") == "Yes", F.col("extracted") == "Yes"
    sums = {
        "n": F.lit(1).cast("bigint"), "right": F.col("score").cast("bigint"), "tp": (gold & pred).cast("bigint"),
        "fp": (~gold & pred).cast("bigint"), "fn": (gold & ~pred).cast("bigint"),
    }
    partial = G.partial_sums(df, [*by, "category"], sums)
    each = partial.withColumn("category", F.explode_outer(F.split(F.col("category"), ",")))
    counts = G.unfold_levels(each, by, {"overall": None, "category": "category"}, list(sums))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * (precision * recall), precision + recall), F.lit(0.0))
    return counts.select(
        *by, "level", "key", "n", (f1 * 100).alias("f1"), (F.col("right") / F.col("n") * 100).alias("acc"),
        (precision * 100).alias("precision"), (recall * 100).alias("recall"),
    )


def yes_no_accuracy(df: DataFrame, by: Sequence[str] = RUN, l2: str | None = "l2_category") -> DataFrame:
    levels: dict[str, str | None] = {"overall": None, "category": "category"}
    if l2:
        levels["l2_category"] = l2
    return G.level_means(df, by, levels, "score", 100.0)


def consistency(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of valid question groups whose rotations are answered consistently."""
    valid = F.when(F.col("valid"), F.col("consistent").cast("double"))
    return flags.groupBy(*by).agg(F.count_if("valid").alias("n"), F.avg(valid).alias("score"))


def letter_hit(opt: Column, gold: Column) -> Column:
    return F.coalesce((opt == gold).cast("int"), F.lit(0))
