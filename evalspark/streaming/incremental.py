"""Score each prediction once as files arrive, and keep a running report.

Each micro-batch is scored, reduced to sums and appended under its batch number; a re-run of a batch
overwrites its own folder, so the report counts every row once.

:func:`corrections` keeps the latest answer to each key for as long as the watermark allows it to be corrected: a later answer takes the sums of
the earlier one back.  State is as large as the keys of one ``delay``, however long the stream runs;
keys share a state by their hash.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalspark.plans import grouping as G

#: Groups of keys whose newest answers are one state: a call of Python costs as much as many keys.
BUCKETS = 4_096


def read_stream(spark: SparkSession, path: str, schema: ST.StructType, fmt: str = "parquet", files_per_batch: int = 100,
                names: str | None = None) -> DataFrame:
    """Files of a folder as they arrive; ``names`` is a file name pattern."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    return (reader if names is None else reader.option("pathGlobFilter", names)).load(path)


def first_arrivals(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key once; with an event time the state is dropped after ``delay``."""
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def corrections(scored: DataFrame, keys: Sequence[str], event_time: str, tie: str, columns: Sequence[str], delay_ms: int = 86_400_000) -> DataFrame:
    """Signed rows of a scored stream: ``columns`` and ``sign``.

    A key's newest answer (by ``event_time``, then the whole number ``tie``) counts 1; when a newer one comes, the earlier one counts -1.  Rows behind the
    watermark are left out, and a key is forgotten ``delay_ms`` after its newest answer, so corrections must come within that time.
    """
    chosen = scored.select(*keys, event_time, tie, *[c for c in columns if c not in keys]).withWatermark(event_time, f"{delay_ms} milliseconds")
    kinds = {f.name: f.dataType for f in chosen.schema}
    state = ST.StructType([ST.StructField("held", ST.BinaryType())])
    output = ST.StructType([*[ST.StructField(c, kinds[c]) for c in columns], ST.StructField("sign", ST.IntegerType())])

    def values(frame: pd.DataFrame, names: Sequence[str]) -> Iterator[tuple]:
        plain = lambda c: [None if x is None or x is pd.NA or x != x else x for x in frame[c].tolist()]
        return zip(*[plain(c) for c in names], strict=True)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        mark = kept.getCurrentWatermarkMs()
        # Key -> time and number of its newest answer, until when it can be corrected, and what was counted.
        held = pickle.loads(kept.get[0]) if kept.exists else {}
        before = {}
        for frame in () if kept.hasTimedOut else frames:
            at = frame[event_time].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for name, when, number, counted in zip(values(frame, keys), at, frame[tie].tolist(), values(frame, columns), strict=True):
                old = held.get(name)
                if old is None or (when, number) > old[:2]:
                    before.setdefault(name, old)
                    held[name] = (when, number, max(when // 1000, mark) + delay_ms, counted)
        signed = [(*old[3], -1) for old in before.values() if old is not None] + [(*held[name][3], 1) for name in before]
        # Never behind the watermark, which must not be passed when a time is set.
        held = {name: x for name, x in held.items() if x[2] >= mark}
        if held:
            kept.update((pickle.dumps(held),))
            kept.setTimeoutTimestamp(min(x[2] for x in held.values()))
        elif kept.exists:
            kept.remove()
        if signed:
            yield pd.DataFrame(signed, columns=[*columns, "sign"])

    grouped = chosen.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("_bucket")
    return grouped.applyInPandasWithState(newest, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def sum_corrections(
    signed: DataFrame, out: str, checkpoint: str, *, by: Sequence[str] = ("model", "dataset"), levels: dict[str, str | None] | None = None, value: str = "hit",
) -> StreamingQuery:
    """Sums of signed rows to ``out/sums``, one folder per micro-batch, for all files that are there; a later call goes on where this one ended."""
    levels = {"overall": None} if levels is None else levels

    def write(batch: DataFrame, number: int) -> None:
        sums = {"total": F.col(value).cast("double") * F.col("sign"), "n": F.when(F.col(value).isNotNull(), F.col("sign")).otherwise(0).cast("bigint")}
        G.level_sums(batch, by, levels, sums).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")

    return signed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def score_stream(
    stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *,
    by: Sequence[str] = ("model", "dataset"), levels: dict[str, str | None] | None = None, value: str = "hit",
    available_now: bool = True,
) -> StreamingQuery:
    """Scored rows to ``out/rows`` and their sums to ``out/sums``, one folder per micro-batch."""
    levels = {"overall": None} if levels is None else levels

    def write(batch: DataFrame, number: int) -> None:
        rows = scorer(batch).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
            sums = {"total": F.col(value).cast("double"), "n": F.col(value).isNotNull().cast("bigint")}
            G.level_sums(rows, by, levels, sums).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_report(spark: SparkSession, out: str, by: Sequence[str] = ("model", "dataset")) -> DataFrame:
    """Report over all batches so far."""
    sums = spark.read.parquet(f"{out}/sums")
    totals = sums.groupBy(*by, "level", "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    # A group whose rows were all taken back is no group.
    return totals.where("n <> 0").select(*by, "level", "key", "n", F.try_divide("total", "n").alias("score"))


def scored_rows(spark: SparkSession, out: str, columns: Sequence[Column | str]) -> DataFrame:
    return spark.read.parquet(f"{out}/rows").select(*columns)
