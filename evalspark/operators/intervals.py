"""Interval join of points in time with spans: the first span, in file order, that holds a point.

Spans are cut along a tree of aligned blocks (sizes are powers of a base) into as few blocks as possible: at most ``base - 1`` on either side
at each level.  The tree is as high as the longest span needs, so a span of days is cut into some dozens of blocks like one of
seconds.  Blocks are reduced to one row each, with the text of the first span, before points look their enclosing blocks up: an equi-join whose
right side has one row per key, so no pairs are produced, and a busy video spreads over as many keys as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import text as T

_BASE = 4


def _blocks(low: Column, high: Column, base: int, levels: int) -> Column:
    """Aligned blocks ``(level, block)`` that exactly cover the whole numbers low..high."""
    none = F.array().cast("array<bigint>")
    parts = []
    for level in range(levels):
        size = base**level
        first, stop = F.ceil(low / size).cast("bigint"), F.floor((high + 1) / size).cast("bigint")
        whole = F.when(first < stop, F.sequence(first, stop - 1)).otherwise(none)
        if level < levels - 1:
            up = size * base
            up_first, up_stop = F.ceil(low / up).cast("bigint"), F.floor((high + 1) / up).cast("bigint")
            left = F.when(first < up_first * base, F.sequence(first, up_first * base - 1)).otherwise(none)
            right = F.when(up_stop * base < stop, F.sequence(up_stop * base, stop - 1)).otherwise(none)
            whole = F.when(up_first < up_stop, F.concat(left, right)).otherwise(whole)
        parts.append(_at_level(whole, level))
    return F.concat(*parts)


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def levels_for(longest: int | None, base: int = _BASE) -> int:
    """Height of the tree for spans of up to ``longest`` whole numbers."""
    levels = 1
    while base ** levels < (longest or 0):
        levels += 1
    return levels


def first_covering(
    points: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    *,
    time: str = "t_ms",
    start: str = "start_ms",
    end: str = "end_ms",
    pos: str = "pos",
    value: str = "text",
    base: int = _BASE,
) -> DataFrame:
    """Points with ``value`` of the first span (least ``pos``) with ``start < time < end``; NULL when none.

    Times are whole numbers (milliseconds) and ``pos`` is unique within ``by``.  Output columns: those of ``points``, plus ``value``.
    """
    longest = spans.agg(F.max(F.col(end) - F.col(start) - 1)).first()[0]
    levels = levels_for(longest, base)
    covered = spans.select(*by, F.struct(F.col(pos).alias("pos"), F.col(value).alias("value")).alias("_first"), (F.col(start) + 1).alias("_lo"), (F.col(end) - 1).alias("_hi"))
    blocks = (
        covered.where(F.col("_lo") <= F.col("_hi"))
        # The outer form keeps Spark from computing the blocks once more for a filter it would infer.
        .withColumn("_b", F.explode_outer(_blocks(F.col("_lo"), F.col("_hi"), base, levels)))
        .groupBy(*by, "_b.level", "_b.block")
        .agg(F.min("_first").alias("_first"))
    )
    times = points.select(*by, time).distinct()
    enclosing = F.array(*[
        F.struct(F.lit(i).alias("level"), F.floor(F.col(time) / base**i).alias("block")) for i in range(levels)
    ])
    first = (
        times.withColumn("_b", F.explode(enclosing))
        .select(*by, time, "_b.level", "_b.block")
        .join(blocks, [*by, "level", "block"], "inner")
        .groupBy(*by, time)
        .agg(F.min("_first").alias("_first"))
        .select(*by, time, F.col("_first.value").alias(value))
    )
    return points.join(first, [*by, time], "left").select(*points.columns, value)


def frame_subtitles(frames: DataFrame, subtitles: DataFrame, by: Sequence[str] = ("video",), **columns: str) -> DataFrame:
    """Subtitle line of every frame: line breaks as spaces, NULL for none or blank."""
    value = columns.get("value", "text")
    line = F.replace(F.col(value), F.lit("\\N"), F.lit(" "))
    joined = first_covering(frames, subtitles, by, **columns)
    return joined.withColumn("subtitle", F.when(T.strip(line) != "", line)).drop(value)


def prompt_subtitles(frames: DataFrame, subtitles: DataFrame, prompt_keys: Sequence[str], by: Sequence[str] = ("video",),
                     frame_no: str = "frame_no", **columns: str) -> DataFrame:
    """Subtitle block of each prompt: lines of its sampled frames in frame order.

    A prompt has as many rows as frames were sampled for it, a number fixed by the caller.
    """
    lines = frame_subtitles(frames, subtitles, by, **columns)
    ordered = F.array_sort(F.collect_list(F.when(F.col("subtitle").isNotNull(), F.struct(frame_no, "subtitle"))))
    text = F.array_join(F.transform(ordered, lambda x: x["subtitle"]), "\n")
    return lines.groupBy(*prompt_keys).agg(text.alias("subtitles"))
