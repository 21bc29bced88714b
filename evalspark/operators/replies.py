"""Judge replies as data: rows that rules leave open become prompts, a table of replies is joined back, and rows are scored again.

No call to a judge is made here.  :func:`requests` gives what a judge is to be asked; its replies come as a table with the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import answers as A
from evalspark.functions import prompts as P
from evalspark.operators import circular as C
from evalspark.operators import keys as OK
from evalspark.operators.scorers import Options


def requests(rows: DataFrame, kind: str, keys: Sequence[str], prompt: Column, is_open: Column) -> DataFrame:
    """``kind, keys, prompt`` of the rows a judge is to be asked about; one row per key."""
    asked = rows.where(is_open).select(F.lit(kind).alias("kind"), *keys, prompt.alias("prompt"))
    return asked.groupBy("kind", *keys).agg(F.min("prompt").alias("prompt"))


def attach_replies(rows: DataFrame, replies: DataFrame, keys: Sequence[str], kind: str | None = None, pos: str | None = None) -> DataFrame:
    """Rows with ``reply``; NULL where there is none.  Of several replies to a key the last by ``pos`` (or the greatest) counts."""
    own = replies if kind is None else replies.where(F.col("kind") == kind)
    order = F.struct(*([F.col(pos)] if pos else []), F.col("reply"))
    latest = own.groupBy(*keys).agg(F.max(order)["reply"].alias("reply"))
    return rows.join(latest, list(keys), "left")


def explode_dialogues(df: DataFrame, keys: Sequence[str], question: str = "question", answer: str = "answer", prediction: str = "prediction") -> DataFrame:
    """One row per question of a dialogue: ``keys, turn, question, answer, prediction``, with turns from 0; lists that are shorter give NULL."""
    turns = F.arrays_zip(F.col(question).alias("q"), F.col(answer).alias("a"), F.col(prediction).alias("p"))
    rows = df.select(*keys, F.size(question).alias("_n"), F.posexplode(turns).alias("turn", "_t")).where(F.col("turn") < F.col("_n"))
    return rows.select(*keys, "turn", F.col("_t.q").alias("question"), F.col("_t.a").alias("answer"), F.col("_t.p").alias("prediction"))


def dialogue_requests(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a judge is asked about each turn of each dialogue."""
    return requests(turns, "dialogue", [*keys, "turn"], P.dialogue_judge("question", "answer", "prediction"), F.lit(True))


def pair_requests(rows: DataFrame, keys: Sequence[str], caption: str = "caption", question: str = "question", baseline: str = "answer", prediction: str = "prediction") -> DataFrame:
    """What a judge is asked about a reply beside the baseline's."""
    return requests(rows, "pair", keys, P.pair_judge(caption, question, baseline, prediction), F.lit(True))


def video_requests(rows: DataFrame, keys: Sequence[str], question: str = "question", answer: str = "answer", prediction: str = "prediction") -> DataFrame:
    """What a judge is asked about an answer that scores 0 to 3."""
    return requests(rows, "video", keys, P.video_judge(question, answer, prediction), F.lit(True))


def guess_letter(key: Column, letters: Column) -> Column:
    """Stable stand-in for a random pick among the options and Z, by the MD5 of the key."""
    pool = F.array_union(letters, F.array(F.lit("Z")))
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.get(pool, (number % F.size(pool)).cast("int"))


def rescore_options(rows: DataFrame, options: Options, key: str, gold: str = "gt") -> DataFrame:
    """``opt`` and ``hit`` anew: the rule's letter, else the reply's, else a stable guess."""
    judged = F.coalesce("opt", A.infer_option("reply", options, ""), guess_letter(F.col(key), A.present_letters(options)))
    return rows.withColumn("opt", judged).withColumn("hit", F.coalesce((F.col("opt") == F.col(gold)).cast("int"), F.lit(0)))


def rescore_yes_no(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """``extracted`` and ``score`` anew: Unknown rows take what the reply says."""
    judged = F.when(F.col("extracted") == "Unknown", A.yes_no("reply")).otherwise(F.col("extracted"))
    return rows.withColumn("extracted", judged).withColumn("score", F.coalesce((F.col(answer) == F.col("extracted")).cast("int"), F.lit(0)))


def rescore_circular(rows: DataFrame, options: Options, by: Sequence[str] = (), index: str = "index", gold: str = "gt", offset: int = 1_000_000) -> DataFrame:
    """Groups scored with the replies of their open rows; a group with a wrong rotation stays wrong whatever a judge says."""
    opt = F.coalesce(A.infer_option("prediction", options), A.infer_option("reply", options, ""))
    return C.score_circular(rows, options, by=by, index=index, gold=gold, opt=opt, offset=offset)


def open_rotations(rows: DataFrame, options: Options, by: Sequence[str] = (), index: str = "index", gold: str = "gt", offset: int = 1_000_000) -> DataFrame:
    """Rows without a letter of groups that a judge can still turn into a hit."""
    groups = C.undecided_groups(C.score_circular(rows, options, by=by, index=index, gold=gold, offset=offset)).select(*by, F.col(index).alias("_gid"))
    opened = rows.where(A.infer_option("prediction", options).isNull()).withColumn("_gid", OK.main_key(index, offset))
    return opened.join(groups, [*by, "_gid"], "left_semi").drop("_gid")
