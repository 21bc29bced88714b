"""Key look-ups and precedence rules on prediction tables.

Precedence is a ``row_number() = 1`` filter: Spark keeps one row per key and task before the shuffle
(window group limit), so a key with very many copies never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def last_wins(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row per key: the one with the greatest position."""
    return _one_per_key(df, keys, [F.col(pos).desc_nulls_last()])


def attach_answers(predictions: DataFrame, answers: DataFrame, keys: Sequence[str], answer: str = "answer",
                   pos: str | None = None, name: str = "gt") -> DataFrame:
    """Keep predictions whose key has an answer and add that answer as ``name``.

    With ``pos`` the answer table may hold duplicates and the last one counts.
    """
    gold = answers if pos is None else last_wins(answers.select(*keys, answer, pos), keys, pos)
    return predictions.join(gold.select(*keys, F.col(answer).alias(name)), list(keys), "inner")


def known_only(predictions: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.join(meta.select(*keys), list(keys), "left_semi")


def unknown_predictions(predictions: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions whose key is not in the data set (must be empty)."""
    return predictions.join(meta.select(*keys), list(keys), "left_anti")


def pending(rows: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have no result yet."""
    return rows.join(results.select(*keys), list(keys), "left_anti")


def attach_results(rows: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(results, list(keys), "left")


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of shards; a key in a later shard replaces the same key of an earlier one."""
    tagged = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    merged = tagged[0]
    for s in tagged[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    return last_wins(merged, keys, "_shard").drop("_shard")


def missing_keys(meta: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the data set without a merged result (empty when complete)."""
    return pending(meta.select(*keys), merged, keys)


def resume(previous: DataFrame, current: DataFrame, keys: Sequence[str], *, ignore_failed: bool = False) -> DataFrame:
    """Results of an earlier run overridden by the current one.

    Failed rows of the earlier run are dropped, to be asked again, unless ``ignore_failed``.
    """
    kept = previous if ignore_failed else previous.where(~T.is_failure("prediction"))
    return merge_shards([kept, current], keys)


def source_precedence(df: DataFrame, keys: Sequence[str], priority: str, pos: str) -> DataFrame:
    """One row per key from the source with the greatest priority, the last position within it."""
    return _one_per_key(df, keys, [F.col(priority).desc(), F.col(pos).desc()])


def failed(df: DataFrame) -> DataFrame:
    return df.where(T.is_failure("prediction"))


def run_matrix(models: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Every model with every data set of a fixed list."""
    return models.select("model", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))


def missing_runs(models: DataFrame, datasets: Sequence[str], completed: DataFrame,
                 parts: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Runs not completed; a combined data set counts as done when all its parts are."""
    done = completed.select("model", "dataset").distinct()
    for whole, pieces in (parts or {}).items():
        flags = [F.bool_or(F.col("dataset") == p).alias(f"_p{i}") for i, p in enumerate(pieces)]
        all_parts = done.groupBy("model").agg(*flags)
        for i in range(len(pieces)):
            all_parts = all_parts.where(F.col(f"_p{i}"))
        done = done.unionByName(all_parts.select("model", F.lit(whole).alias("dataset")))
    return run_matrix(models, datasets).join(done, ["model", "dataset"], "left_anti")


def shard_of(key: Column | str, shards: int) -> Column:
    """Shard number of a key, stable across runs."""
    return F.pmod(F.xxhash64(T.col(key)), F.lit(shards)).cast("int")


def main_key(index: Column | str, offset: int = K.ROTATION_OFFSET) -> Column:
    return T.col(index) % offset


def rotation(index: Column | str, offset: int = K.ROTATION_OFFSET) -> Column:
    return F.floor(T.col(index) / offset)
