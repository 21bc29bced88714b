"""Batch calls of a model or judge given by the user, with retries, resume and second passes.

The callable is the extension point: it gets a prompt (and a temperature) and returns text.  Rows reach it
through ``mapInPandas``; replies are appended to a Parquet table and never asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark import constants as K
from evalspark.functions import text as T
from evalspark.operators import keys as OK

Generate = Callable[..., str]
Accept = Callable[[str], bool]

_REPLY = [
    ST.StructField("reply", ST.StringType()),
    ST.StructField("tries", ST.IntegerType()),
    ST.StructField("log", ST.StringType()),
]


def answered(reply: str) -> bool:
    """Default test of a usable reply."""
    return bool(reply) and K.FAIL_MARKER not in reply


def _ask(generate: Generate, accept: Accept, prompt: str | None, tries: int) -> tuple[str, int, str]:
    log = ""
    for attempt in range(tries):
        try:
            reply = generate(prompt, temperature=0.5 * attempt)
        except Exception as error:  # a failed call is one failed try
            reply = f"{K.FAIL_MESSAGE} {type(error).__name__}"
        if accept(reply):
            return reply, attempt + 1, log + K.SUCCEEDED_LOG
        log += K.TRY_LOG.format(attempt=attempt, reply=reply)
    return "", tries, log + K.TRIES_LOG.format(tries=tries)


def apply_callable(
    df: DataFrame, generate: Generate, *, prompt: str = "prompt", accept: Accept = answered, tries: int = 5
) -> DataFrame:
    """Every row with ``reply, tries, log``; the first accepted reply wins, ``''`` when none is."""
    schema = ST.StructType([*df.schema.fields, *_REPLY])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = [_ask(generate, accept, p, tries) for p in batch[prompt]]
            yield batch.assign(
                reply=[a[0] for a in asked], tries=pd.array([a[1] for a in asked], dtype="int32"), log=[a[2] for a in asked]
            )

    return df.mapInPandas(run, schema)


def judge_unresolved(
    df: DataFrame, unresolved: Column, generate: Generate, *, prompt: str = "prompt", accept: Accept = answered, tries: int = 5
) -> DataFrame:
    """Only rows that need a judge pass through Python; the others keep NULL replies."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in _REPLY}
    flagged = df.withColumn("_ask", F.coalesce(unresolved, F.lit(False)))
    settled = flagged.where(~F.col("_ask")).drop("_ask").withColumns(empty)
    asked = apply_callable(flagged.where("_ask").drop("_ask"), generate, prompt=prompt, accept=accept, tries=tries)
    return settled.unionByName(asked)


class ResultStore:
    """Append-only Parquet table of replies, keyed by run and row."""

    def __init__(self, spark: SparkSession, path: str, schema: ST.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, df: DataFrame) -> None:
        df.select(*[f.name for f in self.schema.fields]).write.mode("append").parquet(self.path)


def run_resumable(
    rows: DataFrame, generate: Generate, store: ResultStore, *, prompt: str = "prompt", accept: Accept = answered,
    tries: int = 1, chunks: int = 1,
) -> DataFrame:
    """Ask for rows without a stored reply, chunk by chunk, and return all replies.

    Each chunk is one job that appends its replies; after a crash only unfinished chunks are asked again.
    A later stored reply of a key replaces an earlier one.
    """
    for chunk in range(chunks):
        todo = OK.pending(rows, store.read(), store.keys)
        if chunks > 1:
            todo = todo.where(OK.shard_of(F.concat_ws("|", *store.keys), chunks) == chunk)
        replies = apply_callable(todo, generate, prompt=prompt, accept=accept, tries=tries)
        store.append(replies.withColumn("pass", F.lit(0)))
    return latest(store)


def latest(store: ResultStore) -> DataFrame:
    return OK.last_wins(store.read(), store.keys, "pass")


def second_pass(rows: DataFrame, generate: Generate, store: ResultStore, *, number: int = 1, **options) -> DataFrame:
    """Ask again for rows whose stored reply is empty or marked as failed."""
    bad = latest(store).where((F.col("reply") == "") | T.is_failure("reply")).select(*store.keys)
    again = apply_callable(rows.join(bad, store.keys, "left_semi"), generate, **options)
    store.append(again.withColumn("pass", F.lit(number)))
    return latest(store)


def store_schema(rows: DataFrame, keys: Sequence[str]) -> ST.StructType:
    return ST.StructType([*[rows.schema[k] for k in keys], *_REPLY, ST.StructField("pass", ST.IntegerType())])


def judge_rounds(
    rows: DataFrame, generate: Generate, parse: Column, store: ResultStore, *, prompt: str = "prompt", tries: int = 3
) -> DataFrame:
    """Retry ladder with a parser written as a column: round t asks the rows no earlier reply settled.

    ``parse`` reads column ``reply``.  Rounds are jobs, and replies are kept in the store.
    """
    def settled() -> DataFrame:
        return store.read().where(parse.isNotNull())

    for attempt in range(tries):
        todo = OK.pending(rows, settled(), store.keys)

        def ask(text: str, temperature: float = 0.0, at: int = attempt) -> str:
            return generate(text, temperature=0.5 * at)

        store.append(apply_callable(todo, ask, prompt=prompt, tries=1).withColumn("pass", F.lit(attempt)))
    first = settled().withColumn("_order", -F.col("pass"))
    return OK.last_wins(first, store.keys, "_order").drop("_order").withColumn("parsed", parse)


def multi_turn(
    turns: DataFrame, chat: Callable[[list[dict]], str], *, key: str = "conv_id", order: str = "turn", budget: int | None = None
) -> DataFrame:
    """Replies to the user turns of each conversation, each asked with all turns before it.

    Conversations are co-located and sorted, then streamed: only the current conversation's context is
    held, cut to ``budget`` characters (oldest turns first, then up to the next user turn) when given.
    """
    schema = ST.StructType([turns.schema[key], turns.schema[order], ST.StructField("reply", ST.StringType())])
    users = turns.where("role = 'user'").select(key, order, "text")

    def fit(stack: list[dict]) -> list[dict]:
        while budget is not None and stack and sum(len(m["content"]) for m in stack) > budget:
            stack = stack[1:]
            while stack and stack[0]["role"] != "user":
                stack = stack[1:]
        return stack

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stack = None, []
        for batch in batches:
            replies = []
            for conv, text in zip(batch[key], batch["text"], strict=True):
                if conv != current:
                    current, stack = conv, []
                stack = fit([*stack, {"role": "user", "content": text}])
                try:
                    reply = chat(stack) if stack else K.FAIL_MESSAGE
                except Exception:  # a failed turn is answered with the failure text
                    reply = K.FAIL_MESSAGE
                stack = [*stack, {"role": "assistant", "content": reply}]
                replies.append(reply)
            yield pd.DataFrame({key: batch[key], order: batch[order], "reply": replies})

    return users.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
