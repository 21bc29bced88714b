"""Reports on open answers: VQA, OCR, maths, tables, documents, captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T
from evalspark.operators import captions as C
from evalspark.plans import grouping as G

RUN = ("model", "dataset")


def vqa(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Mean hit in percent: per split where there are splits, else per category; always overall."""
    level = "split" if "split" in df.columns else ("category" if "category" in df.columns else None)
    levels: dict[str, str | None] = {"overall": None}
    if level:
        levels[level] = level
    return G.level_means(df, by, levels, "hit", 100.0)


def containment(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    report = G.level_means(df, by, {"average": None, "category": "category"}, "hit", 100.0)
    return report.withColumn("key", F.when(F.col("level") == "average", "Average").otherwise(F.col("key")))


def ocr_card(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Hit counts per group of categories, the final score and its tenth."""
    def hits(names: Sequence[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("category").isin(list(names)), F.col("hit"))), F.lit(0)).cast("double")

    groups = {"Text Recognition": K.OCR_TEXT_RECOGNITION, **{c: [c] for c in K.OCR_OTHER}}
    totals = df.groupBy(*by).agg(*[hits(v).alias(k) for k, v in groups.items()])
    final = sum((F.col(f"`{k}`") for k in groups), F.lit(0.0))
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("score")) for k in groups],
        F.struct(F.lit("Final Score").alias("key"), final.alias("score")),
        F.struct(F.lit("Final Score Norm").alias("key"), (final / 10).alias("score")),
    )
    return totals.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.key", "_e.score")


def _attempts(df: DataFrame, by: Sequence[str], names: Column, groups: Sequence[str], pos: str | None) -> DataFrame:
    sums = [
        F.count(F.lit(1)).alias("tot"), F.count_if(F.col("log") == K.PREFETCH_OK).alias("prefetch"),
        F.sum("hit").alias("hit"), *([F.min(pos).alias("first_pos")] if pos else []),
    ]
    partial = df.groupBy(*by, *groups).agg(*sums)
    each = partial.select(*by, F.posexplode(names).alias("place", "key"), "tot", "prefetch", "hit", *(["first_pos"] if pos else []))
    totals = each.groupBy(*by, "key").agg(
        F.sum("tot").alias("tot"), F.sum("prefetch").alias("prefetch"), F.sum("hit").alias("hit"),
        *([F.min(F.struct("first_pos", "place")).alias("first")] if pos else []),
    )
    return totals.select(
        *by, "key", "tot", "prefetch", "hit", (F.col("prefetch") / F.col("tot") * 100).alias("prefetch_rate"),
        (F.col("hit") / F.col("tot") * 100).alias("acc"),
        *([F.col("first.first_pos").alias("first_pos"), F.col("first.place").alias("first_place")] if pos else []),
    )


def task_skill(df: DataFrame, by: Sequence[str] = RUN, pos: str | None = None) -> DataFrame:
    """Attempts and accuracy overall, per skill and per task (one name space), in order of appearance with ``pos``."""
    names = F.concat(F.array(F.lit(G.OVERALL)), T.to_list("skills"), F.array("task"))
    return _attempts(df, by, names, ["task", "skills"], pos)


def subject(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    return _attempts(df, by, F.array(F.lit(G.OVERALL), F.col("category")), ["category"], None)


def tables(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Accuracy in percent per split, smoothed and rounded; the financial split has a relaxed and an exact score."""
    def share(c: Column) -> Column:
        return F.round((F.sum(c) + 1e-9) / (F.count(F.lit(1)) + 1e-9), 8) * 100

    financial = F.col("split") == "fintabnetqa"
    exact = F.coalesce(F.when(financial, F.col("exact_score")), F.col("score"), F.lit(0))
    return df.where(F.col("split").isin(K.TABLE_SPLITS)).groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("n"), share(F.coalesce("score", F.lit(0))).alias("score"), share(exact).alias("exact_score"),
        F.count_if(F.col("score").isNull()).alias("unparsed"),
    )


def documents(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """F1 over answerable rows, accuracy, and mean score per evidence source and page count.

    Rows are summed to distinct list cells first, so each cell is parsed once and not for each measure of each row.
    """
    answerable = {"_gold": F.col("answer") != K.NOT_ANSWERABLE, "_pred": F.col("pred") != K.NOT_ANSWERABLE}
    cells = df.groupBy(*by, "evidence_sources", "evidence_pages", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in answerable.items()]).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"))
    parsed = cells.select(*by, "_n", "_s", *answerable, T.list_or_empty("evidence_sources").alias("_sources"), F.size(T.list_or_empty("evidence_pages")).alias("_pages"))
    pages = F.col("_pages")
    conditions = {"overall_acc": F.lit(True)}
    conditions |= {name: F.array_contains("_sources", source) for name, source in K.EVIDENCE_SOURCES.items()}
    conditions |= {"single-page": pages == 1, "multi-page": pages > 1, "unanswerable": pages == 0}
    conditions |= {name: F.col(name) for name in answerable}
    aggregates = []
    for name, test in conditions.items():
        aggregates += [F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0)).alias(f"n {name}"), F.sum(F.when(test, F.col("_s"))).alias(f"s {name}")]
    totals = parsed.groupBy(*by).agg(*aggregates)

    def mean(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"`s {name}`"), F.col(f"`n {name}`")), F.lit(0.0))

    recall, precision = mean("_gold"), mean("_pred")
    f1 = F.try_divide(2 * recall * precision, recall + precision)
    entries = [F.struct(F.lit("overall_f1").alias("category"), F.col("`n overall_acc`").alias("num"), f1.alias("avg_score"))]
    entries += [
        F.struct(F.lit(name).alias("category"), F.col(f"`n {name}`").alias("num"), mean(name).alias("avg_score"))
        for name in conditions if not name.startswith("_")
    ]
    return totals.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")


def mean_columns(df: DataFrame, columns: dict[str, str], by: Sequence[str] = RUN) -> DataFrame:
    """Mean of each column as rows ``category, num, avg``."""
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).cast("double")).alias(f"_{c}") for c in columns])
    entries = [
        F.struct(F.lit(label).alias("category"), F.col("_n").alias("num"), F.col(f"_{c}").alias("avg")) for c, label in columns.items()
    ]
    return totals.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")


def document_anls(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    return mean_columns(df, {"score": "anls"}, by)


def slides(df: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    return mean_columns(df, {"anls": "anls", "em": "EM", "f1": "F1"}, by)


def recovery(blanks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean exact match and Jaccard over all blanks."""
    return blanks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("exact_match").alias("Exact_Match"), F.avg("jaccard").alias("Jaccard")
    )


def captions(df: DataFrame, by: Sequence[str] = RUN, index: str = "idx") -> DataFrame:
    """BLEU-1..4, ROUGE-L and CIDEr in percent, one row per run, of ``prediction`` against ``references``.

    Rows are known by ``by`` and ``index`` together: two models may answer the same index.
    """
    keys = [*by, index]
    counted = C.caption_grams(df, keys, rouge=True)
    rouge = counted.where(F.size("ref_words") > 0).groupBy(*by).agg((F.avg("rouge_l") * 100).alias("ROUGE_L"))
    cider = C.cider(counted, keys, by).groupBy(*by).agg((F.avg("cider") * 100).alias("CIDEr"))
    return G.merge_measures([C.bleu(counted, by), rouge, cider], by)
