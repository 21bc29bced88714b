"""Row generation: frame numbers, list explosion, pages, packs of questions, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import documents as DOC
from evalspark.functions import text as T
from evalspark.operators.order import blocks_of, join_groups, number_within


def uniform_frames(n_frames: Column | str, k: int) -> Column:
    """k frame numbers, evenly spaced inside the clip."""
    n = T.col(n_frames)
    step = n / F.lit(k + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.floor(i * step).cast("int"))


def segment_frames(
    max_frame: Column | str, k: int, fps: Column | None = None, start: Column | None = None, end: Column | None = None,
    first: int = 0,
) -> Column:
    """Middle frames of k equal segments, inside an optional (start, end) bound in seconds."""
    last = T.col(max_frame).cast("double")
    if fps is None:
        low, high = F.lit(0.0), last
    else:
        bounded = start.isNotNull() & end.isNotNull()
        low = F.greatest(F.lit(float(first)), F.rint(F.when(bounded, start).otherwise(-100000.0) * fps))
        high = F.least(F.rint(F.when(bounded, end).otherwise(100000.0) * fps), last)
    size = (high - low) / k
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (low + size / 2 + F.rint(size * i)).cast("bigint")
    )


def explode_list(df: DataFrame, items: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per item of an array (or comma list), with its position when asked for."""
    items = F.split(F.col(items), ",") if isinstance(items, str) else items
    if pos is None:
        return df.withColumn(name, F.explode(items))
    return df.select("*", F.posexplode(items).alias(pos, name))


def document_pages(df: DataFrame, pages: str = "image_path", groups: int | None = None, max_pages: int | None = None) -> DataFrame:
    """One row per page with its number and page group; all pages, or the first ``max_pages`` where a benchmark asks for that."""
    kept = df.withColumn("_pages", F.col(pages) if max_pages is None else F.slice(pages, 1, max_pages))
    rows = kept.withColumn("_n", F.size("_pages")).select(
        *[c for c in df.columns if c != pages], "_n", F.posexplode("_pages").alias("page_no", "page")
    )
    return rows.withColumn("page_group", DOC.page_group(F.col("page_no"), F.col("_n"), groups)).drop("_n")


def pack_questions(df: DataFrame, by: Sequence[str] = ("video",), index: str = "index", question: str = "question") -> DataFrame:
    """Questions of each video in order: ``by, position, index, question``, with dense positions from 0.

    The shape is the same at every size; which of them one prompt holds is up to the caller's pack key (:func:`pack_maps`).
    """
    numbered = number_within(df, list(by), index, "position")
    return numbered.select(*by, "position", F.col(index).alias("index"), F.col(question).alias("question"))


def pack_maps(questions: DataFrame, by: Sequence[str], pack: Column) -> DataFrame:
    """One map ``index -> question`` per value of ``pack``, a key whose groups the caller keeps small enough for a prompt."""
    entry = F.struct(F.col("index").cast("string").alias("key"), F.col("question").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("position", entry.alias("e"))))
    return questions.groupBy(*by, pack.alias("pack")).agg(F.map_from_entries(F.transform(ordered, lambda x: x["e"])).alias("questions"))


def running_sum(
    df: DataFrame, by: Sequence[str], order: str, values: dict[str, Column], blocks: int | None = None
) -> DataFrame:
    """Sums over the earlier rows of a group (the row itself excluded).

    Rows are cut into blocks between quantiles of ``order``, so blocks hold about as many rows whatever the values of
    ``order`` are; block totals are summed first, rows within a block second, and a very long group is spread
    over its blocks.  ``order`` must be unique within a group.
    """
    totals = {f"_t_{k}": F.sum(v) for k, v in values.items()}
    tagged = df.withColumn("_block", blocks_of(df, order, blocks))
    summed = tagged.groupBy(*by, "_block").agg(*[v.alias(k) for k, v in totals.items()])
    earlier_blocks = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.select(*by, "_block", *[F.coalesce(F.sum(k).over(earlier_blocks), F.lit(0)).alias(k) for k in totals])
    earlier_rows = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = tagged.withColumns({f"_i_{k}": F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)) for k, v in values.items()})
    joined = join_groups(inner, offsets, [*by, "_block"])
    return joined.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_t_{k}")).alias(k) for k in values])


def dialogue_prefix(turns: DataFrame, by: Sequence[str] = ("conv_id",), order: str = "turn") -> DataFrame:
    """What a model has seen before each turn: earlier turns, characters and image tags."""
    tags = F.size(F.split(F.col("text"), K.IMAGE_HERE)) - 1
    return running_sum(turns, by, order, {
        "turns_before": F.lit(1).cast("bigint"),
        "user_turns_before": (F.col("role") == "user").cast("bigint"),
        "chars_before": F.length("text").cast("bigint"),
        "images_before": tags.cast("bigint"),
    })


def truncate_dialogues(turns: DataFrame, budget: int, by: Sequence[str] = ("conv_id",), order: str = "turn") -> DataFrame:
    """Turns that stay when each dialogue is cut to ``budget`` characters.

    Oldest turns go first, then all up to the next user turn, while the rest is too long.  A dialogue may
    be of any length: sizes are running sums and the cut is one aggregate per dialogue.
    """
    sized = running_sum(turns, by, order, {"_before": F.length("text").cast("bigint"), "_at": F.lit(1).cast("bigint")})
    totals = turns.groupBy(*by).agg(F.sum(F.length("text").cast("bigint")).alias("_total"))
    rest = F.col("_total") - F.col("_before")
    fits = (rest <= budget) & ((F.col("role") == "user") | (F.col("_at") == 0))
    measured = sized.join(totals, list(by))
    cuts = measured.where(fits).groupBy(*by).agg(F.min(order).alias("_first"))
    return turns.join(cuts, list(by)).where(F.col(order) >= F.col("_first")).drop("_first")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
