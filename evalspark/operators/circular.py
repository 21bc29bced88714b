"""Circular multiple choice: option rotations, group scoring and rotation consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import text as T
from evalspark.operators import keys as OK

_OPTIONS = "ABCD"


def _stands_alone(option: Column, n: int) -> Column:
    """False for a last option that names all other letters or says all/none."""
    tokens = T.words(F.replace(option, F.lit(","), F.lit(" ")))
    lowered = T.words(F.replace(F.lower(option), F.lit(","), F.lit(" ")))
    names_all = F.size(F.array_intersect(tokens, F.array(*[F.lit(c) for c in _OPTIONS[: n - 1]]))) == n - 1
    return ~(names_all | F.array_contains(lowered, "all") | F.array_contains(lowered, "none"))


def rotation_class(c: Column | str = "C", d: Column | str = "D") -> Column:
    """How many leading options rotate: 4, 3 or 2."""
    c, d = T.col(c), T.col(d)
    three = F.coalesce(_stands_alone(c, 3), F.lit(False))
    four = F.coalesce(_stands_alone(d, 4), F.lit(False))
    return F.when(four, 4).when(c.isNotNull() & three, 3).otherwise(2)


def rotation_offset(table: DataFrame, index: str = "index") -> Column:
    """Smallest power of ten, at least a million, above every index (one scalar aggregate)."""
    biggest = table.agg(F.max(index).alias("m")).scalar()
    digits = F.length(biggest.cast("string"))
    return F.greatest(F.lit(K.ROTATION_OFFSET), F.pow(F.lit(10.0), digits).cast("bigint"))


def offset_above(table: DataFrame, index: str = "index") -> int:
    """:func:`rotation_offset` as a number, to be handed to expansion and scoring alike."""
    return int(table.select(rotation_offset(table, index)).first()[0] or K.ROTATION_OFFSET)


def expand_rotations(table: DataFrame, index: str = "index", offset: Column | int | None = None) -> DataFrame:
    """Each question with every rotation of its options; copies refer to the source row's image.

    Rotation r moves option i to letter (i + r) mod n, the answer letter with it.
    """
    step = rotation_offset(table, index) if offset is None else F.lit(offset)
    n, r = F.col("_n"), F.col("_r")
    letters = F.array(*[F.lit(c) for c in _OPTIONS])
    options = F.array(*[F.col(c) for c in _OPTIONS])
    moved = table.withColumn("_n", rotation_class()).withColumn("_r", F.explode(F.sequence(F.lit(0), n - 1)))

    def option(i: int) -> Column:
        source = F.when(F.lit(i) < n, F.pmod(F.lit(i) - r, n)).otherwise(i)
        return F.get(options, source)

    answer_at = F.array_position(letters, F.col("answer")).cast("int") - 1
    turned = F.when((answer_at >= 0) & (answer_at < n), F.get(letters, (answer_at + r) % n)).otherwise(F.col("answer"))
    changed: dict[str, Column] = {c: option(i) for i, c in enumerate(_OPTIONS)}
    changed["answer"] = turned
    if "image" in table.columns:
        changed["image"] = F.when(r == 0, F.col("image")).otherwise(F.col(index).cast("string"))
    changed[index] = F.col(index) + r * step
    keep = [F.col(c) for c in table.columns if c not in changed]
    return moved.select(*keep, *[v.alias(k) for k, v in changed.items()])


def score_circular(
    predictions: DataFrame,
    options: Mapping[str, Column | str],
    by: Sequence[str] = (),
    index: str = "index",
    gold: str = "gt",
    opt: Column | None = None,
    offset: int = K.ROTATION_OFFSET,
) -> DataFrame:
    """One row per question group: 1 when every rotation's letter equals its answer, else 0.

    ``offset`` is the step between the indices of a question's rotations, the one its expansion used
    (:func:`offset_above`); every index below it is a question of its own.

    Columns ``hit``, ``n``, ``n_open`` (rows without a letter) and ``log``.  The log names the first wrong
    rotation: rows of a group are first reduced per index, so the window sees one row per rotation.
    """
    inferred = A.infer_option("prediction", options) if opt is None else opt
    wrong = F.col("_opt").isNotNull() & ~F.col("_opt").eqNullSafe(F.col(gold))
    base = predictions.withColumn("_opt", inferred).withColumn("gid", OK.main_key(index, offset))
    detail = F.struct(gold, T.as_text("prediction").alias("p"), "_opt")
    per_index = base.groupBy(*by, "gid", index).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_opt").isNull()).alias("open_rows"),
        F.count_if(wrong).alias("wrong_rows"),
        F.min(F.when(wrong, detail)).alias("detail"),
    )
    before = Window.partitionBy(*by, "gid").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_index.withColumn("rolling", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    first_wrong = F.min(F.when(F.col("wrong_rows") > 0, F.struct(index, "rolling", "detail")))
    grouped = ranked.groupBy(*by, "gid").agg(
        F.sum("rows").alias("n"),
        F.sum("open_rows").alias("n_open"),
        F.sum("wrong_rows").alias("n_wrong"),
        first_wrong.alias("first_wrong"),
        F.bool_or(F.col(index) < offset).alias("has_main"),
    )
    miss = F.col("first_wrong")
    log = (
        F.when(
            miss.isNotNull(),
            F.format_string(
                K.ROTATION_LOG,
                miss["rolling"], miss["detail"][gold], miss["detail"]["p"], miss["detail"]["_opt"],
            ),
        )
        .when(F.col("n_open") == 0, K.ROTATIONS_LOG)
        .otherwise(K.NO_JUDGE_LOG)
    )
    # The hit does without the log's columns: a report that drops the log has neither window nor texts in its plan.
    hit = ((F.col("n_wrong") == 0) & (F.col("n_open") == 0)).cast("int")
    return grouped.where("has_main").select(*by, F.col("gid").alias(index), hit.alias("hit"), "n", "n_open", log.alias("log"))


def undecided_groups(scored: DataFrame) -> DataFrame:
    """Groups a judge can still turn into a hit: nothing wrong yet, some letter missing."""
    return scored.where((F.col("n_open") > 0) & (F.col("log") == K.NO_JUDGE_LOG))


def rotation_flags(
    predictions: DataFrame, by: Sequence[str] = (), index: str = "index", pos: str | None = None, extract=None,
    offset: int = K.ROTATION_OFFSET,
) -> DataFrame:
    """Per question group: do the letters of successive rotations advance by one (mod 4)?

    Non-letters make the group invalid; empty predictions are skipped.  Copies of an index are reduced
    to the last one first, so the window sees at most one row per rotation.
    """
    pick = (lambda c: c) if extract is None else extract
    order = index if pos is None else pos
    rows = OK.last_wins(predictions.select(*by, index, "prediction", *([pos] if pos else [])), [*by, index], order)
    rows = rows.select(*by, index, OK.main_key(index, offset).alias("gid"), pick(F.col("prediction")).alias("p"))
    window = Window.partitionBy(*by, "gid").orderBy(index)
    lagged = rows.withColumn("q", F.lag("p").over(window)).withColumn("q_index", F.lag(index).over(window))
    both = (F.col(index) - F.col("q_index") == offset) & (F.col("p") != "") & (F.col("q") != "")
    letters = F.col("p").rlike("^[A-Z]\\z") & F.col("q").rlike("^[A-Z]\\z")
    step = F.pmod(F.ascii("p") - F.ascii("q"), F.lit(4)) == 1
    return (
        lagged.groupBy(*by, "gid")
        .agg(
            F.bool_or(F.col(index) < offset).alias("has_main"),
            F.coalesce(F.bool_and(F.when(both, letters)), F.lit(True)).alias("valid"),
            F.coalesce(F.bool_and(F.when(both & letters, step)), F.lit(True)).alias("consistent"),
        )
        .where("has_main")
        .drop("has_main")
    )
