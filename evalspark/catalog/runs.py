"""Queries on runs: resume, merge, completeness, failures, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.catalog import answers as AN
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, plain, query, with_view
from evalspark.operators import expand as E
from evalspark.operators import keys as OK
from evalspark.plans import evaluate as EV
from evalspark.plans import grouping as G
from evalspark.plans import run_matrix as RM
from evalspark.plans import run_reports as R

KEYS = ["model", "dataset", "idx"]
_LAST = "row_number() OVER (PARTITION BY model, dataset, idx ORDER BY {o}) = 1"


def _runs(src: Source) -> DataFrame:
    return src.view(FX.RUNS)


@query(with_view(FX.RUNS, """, t AS (SELECT DISTINCT model, dataset, idx FROM fx), d AS (SELECT DISTINCT model, dataset, idx FROM fx
      WHERE source_priority = 1 AND NOT contains(prediction, 'Failed to obtain answer via API.'))
    SELECT t.* FROM t ANTI JOIN d ON t.model = d.model AND t.dataset = d.dataset AND t.idx = d.idx"""))
def resume_antijoin(src: Source) -> DataFrame:
    """Keys that still need a call."""
    rows = _runs(src)
    done = rows.where("source_priority = 1").subtract(OK.failed(rows.where("source_priority = 1")))
    return OK.pending(rows.select(*KEYS).distinct(), done, KEYS)


@query(with_view(FX.RUNS, f""", e AS (SELECT model, dataset, idx, arg_max(prediction, pos) AS prediction, 0 AS s FROM fx WHERE source_priority = 0 GROUP BY ALL
      UNION ALL SELECT model, dataset, idx, arg_max(prediction, pos), 1 FROM fx WHERE source_priority = 1 GROUP BY ALL),
    r AS (SELECT * FROM e QUALIFY {_LAST.format(o="s DESC")}) SELECT model, dataset, idx, prediction FROM r"""))
def shard_merge(src: Source) -> DataFrame:
    """Two shards, the later one overriding the earlier."""
    rows = _runs(src)
    shards = [OK.last_wins(rows.where(F.col("source_priority") == i), KEYS, "pos") for i in (0, 1)]
    return OK.merge_shards(shards, KEYS).select(*KEYS, "prediction")


@query(with_view(FX.RUNS, f""", e AS (SELECT * FROM fx WHERE source_priority = 1 OR NOT contains(prediction, 'Failed to obtain answer via API.')),
    r AS (SELECT * FROM e QUALIFY {_LAST.format(o="source_priority DESC, pos DESC")}) SELECT model, dataset, idx, prediction FROM r"""))
def previous_run_precedence(src: Source) -> DataFrame:
    rows = _runs(src)
    previous = OK.last_wins(rows.where("source_priority = 0").where(~F.contains("prediction", F.lit("Failed to obtain answer via API."))), KEYS, "pos")
    current = OK.last_wins(rows.where("source_priority = 1"), KEYS, "pos")
    return OK.resume(previous, current, KEYS).select(*KEYS, "prediction")


@query(with_view(FX.RUNS, f", r AS (SELECT * FROM fx QUALIFY {_LAST.format(o='source_priority DESC, pos DESC')}) SELECT model, dataset, idx, prediction, pos FROM r"))
def source_precedence(src: Source) -> DataFrame:
    return OK.source_precedence(_runs(src), KEYS, "source_priority", "pos").select(*KEYS, "prediction", "pos")


_DATASETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "RUSH"]


@query("""
    WITH done AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS model, o_orderpriority AS dataset FROM orders),
    two AS (SELECT model FROM done GROUP BY model HAVING bool_or(dataset = '1-URGENT') AND bool_or(dataset = '2-HIGH')),
    al AS (SELECT * FROM done UNION ALL SELECT model, 'RUSH' FROM two),
    m AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS model,
      unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'RUSH']) AS dataset FROM customer)
    SELECT m.model, m.dataset FROM m ANTI JOIN al ON m.model = al.model AND m.dataset = al.dataset""")
def missing_matrix(src: Source) -> DataFrame:
    """Models (customers) without a run (order) of a data set (priority); RUSH needs both of its parts."""
    models = src.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model"))
    done = src.table("orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model"), F.col("o_orderpriority").alias("dataset")
    )
    return OK.missing_runs(models, _DATASETS, done, {"RUSH": ["1-URGENT", "2-HIGH"]})


@query(with_view(FX.RUNS, """ SELECT model, dataset, count(*) FILTER (contains(prediction, 'Failed to obtain answer via API.')) AS failed, count(*) AS total,
      (count(*) FILTER (contains(prediction, 'Failed to obtain answer via API.')))::DOUBLE / count(*) * 100 AS failed_pct FROM fx GROUP BY ALL"""))
def failure_scan(src: Source) -> DataFrame:
    return R.failure_scan(_runs(src))


@query(with_view(FX.RUNS, """, m AS (SELECT DISTINCT idx FROM fx WHERE dataset IN ('1-URGENT', '2-HIGH'))
    SELECT f.pos, f.idx FROM fx f ANTI JOIN m ON f.idx = m.idx"""))
def unknown_predictions(src: Source) -> DataFrame:
    """Predictions outside the data set (the question list covers two of the sets)."""
    rows = _runs(src)
    meta = rows.where("dataset in ('1-URGENT', '2-HIGH')").select("idx")
    return OK.unknown_predictions(rows, meta, ["idx"]).select("pos", "idx")


_METRICS = [
    R.Metric("rush", "1-URGENT", "Overall", "even", 100.0), R.Metric("low", "5-LOW", "Overall", "odd", 100.0),
    R.Metric("sum", "2-HIGH", "Overall", None, 1.0), R.Metric("absent", "9-NONE", "Overall", None, 1.0),
]
_REPORT = """r AS (SELECT model, dataset, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS split, sum(hit)::DOUBLE / count(hit) AS score FROM fx GROUP BY ALL)"""


def _report(src: Source) -> DataFrame:
    rows = _runs(src).withColumn("split", F.when(F.col("pos") % 2 == 0, "even").otherwise("odd"))
    return G.level_means(rows, ["model", "dataset", "split"], {"overall": None}, "hit")


@query(with_view(FX.RUNS, f""", {_REPORT} SELECT model, max(CASE WHEN dataset = '1-URGENT' AND split = 'even' THEN score * 100 END) AS rush,
      max(CASE WHEN dataset = '5-LOW' AND split = 'odd' THEN score * 100 END) AS low,
      round(sum(CASE WHEN dataset = '2-HIGH' THEN score END), 9) AS sum, CAST(NULL AS DOUBLE) AS absent FROM r GROUP BY model"""))
def leaderboard(src: Source) -> DataFrame:
    board = R.leaderboard(_report(src), _METRICS)
    return board.withColumn("sum", F.round("sum", 9))


@query(with_view(FX.RUNS, f""", {_REPORT} SELECT model, dataset AS category, max(CASE WHEN split = 'even' THEN score * 100 END) AS EVEN,
      max(CASE WHEN split = 'odd' THEN score * 100 END) AS ODD FROM r GROUP BY ALL"""))
def report_reshape(src: Source) -> DataFrame:
    report = _report(src).withColumn("key", F.col("dataset"))
    return R.reshape_accuracy(report, ["even", "odd"], by=["model"])


@query(with_view(FX.RUNS, """, s AS (SELECT model, dataset AS metric, sum(hit)::DOUBLE / count(*) * 100 AS score FROM fx GROUP BY ALL),
    p AS (SELECT metric, min(score) AS lo, max(score) AS hi FROM s GROUP BY metric), w AS (SELECT max(hi - lo) * 1.25 AS width FROM p),
    g AS (SELECT metric, width, CASE WHEN (lo + hi) / 2 + width / 2 < 100 THEN (lo + hi) / 2 - width / 2 ELSE 100 - width END AS low FROM p, w)
    SELECT s.model, s.metric, round(low, 6) AS range_low, round(low + width, 6) AS range_high, round((score - low) / width * 100, 6) AS radar
    FROM s JOIN g ON s.metric = g.metric"""))
def radar_normalise(src: Source) -> DataFrame:
    scores = G.level_means(_runs(src), ["model", "dataset"], {"overall": None}, "hit", 100.0).withColumnRenamed("dataset", "metric")
    ranged = R.radar_ranges(scores.select("model", "metric", "score"))
    return ranged.select("model", "metric", *[F.round(c, 6).alias(c) for c in ("range_low", "range_high", "radar")])


@query(with_view(FX.RUNS, " SELECT model, dataset, count(*) AS n FROM fx GROUP BY ALL"))
def value_counts(src: Source) -> DataFrame:
    return E.value_counts(_runs(src), "model", "dataset")




_ALL_RUNS = f"""WITH a AS ({plain(FX.MCQ)}), b AS ({plain(FX.YES_NO)}), c AS ({plain(FX.VQA)}),
    fx AS (SELECT model, 'choices' AS dataset, idx, prediction, answer, A, B, C, D, category, l2_category, split FROM a), {S.infer("fx", S.ABCD)},
    sc AS (SELECT *, CAST(coalesce(opt, 'Z') = answer AS INT) AS hit FROM inferred),
    y AS (SELECT model, category, l2_category, CAST(answer = CASE idx % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 3 THEN 'Yes' WHEN 5 THEN 'No' ELSE 'Unknown' END AS INT) AS score FROM b),
    e AS (SELECT model, split, CAST(lower(trim(category)) = lower(trim(prediction)) OR lower(trim(model)) = lower(trim(prediction)) AS INT) AS hit FROM c)
    SELECT model, dataset, split, level, key, n, round(score, 9) AS score FROM (
      SELECT model, 'choices' AS dataset, split, 'overall' AS level, 'Overall' AS key, count(*) AS n, sum(hit)::DOUBLE / count(*) AS score FROM sc GROUP BY ALL
      UNION ALL SELECT model, 'choices', split, 'l2_category', l2_category, count(*), sum(hit)::DOUBLE / count(*) FROM sc GROUP BY ALL
      UNION ALL SELECT model, 'choices', split, 'category', category, count(*), sum(hit)::DOUBLE / count(*) FROM sc GROUP BY ALL
      UNION ALL SELECT model, 'yes-no', 'none', 'overall', 'Overall', count(*), sum(score)::DOUBLE / count(*) * 100 FROM y GROUP BY ALL
      UNION ALL SELECT model, 'yes-no', 'none', 'category', category, count(*), sum(score)::DOUBLE / count(*) * 100 FROM y GROUP BY ALL
      UNION ALL SELECT model, 'yes-no', 'none', 'l2_category', l2_category, count(*), sum(score)::DOUBLE / count(*) * 100 FROM y GROUP BY ALL
      UNION ALL SELECT model, 'words', 'none', 'overall', 'Overall', count(*), sum(hit)::DOUBLE / count(*) * 100 FROM e GROUP BY ALL
      UNION ALL SELECT model, 'words', 'none', 'split', split, count(*), sum(hit)::DOUBLE / count(*) * 100 FROM e GROUP BY ALL)"""


@query(_ALL_RUNS)
def evaluate_runs(src: Source) -> DataFrame:
    """One table of predictions for three families of data sets, evaluated in one job."""
    keep = ["model", "prediction", "answer", "category", "split"]
    choices = src.view(FX.MCQ).select(*keep, "l2_category", *"ABCD", F.lit("choices").alias("dataset"))
    yes_no = src.view(FX.YES_NO).select("model", "prediction", "answer", "category", "l2_category", F.lit("yes-no").alias("dataset"))
    golds = F.to_json(F.array("category", "model"))
    words = src.view(FX.VQA).withColumn("answer", golds).select(*keep, F.lit("words").alias("dataset"))
    table = choices.unionByName(yes_no, allowMissingColumns=True).unionByName(words, allowMissingColumns=True)
    report = EV.evaluate_runs(table, {"choices": "choice", "yes-no": "yes_no", "words": "vqa_exact"})
    report = report.withColumn("split", F.when(F.col("level") == "split", "none").otherwise(F.col("split")))
    return report.withColumn("score", F.round("score", 9))


_JUDGED_RUNS = """
SELECT event_id AS idx, 'm' || CAST(user_id % 4 AS STRING) AS model,
  CASE event_id % 4 WHEN 0 THEN 'MMVet' WHEN 1 THEN 'MathVista_MINI' WHEN 2 THEN 'LLaVABench' ELSE 'other' END AS dataset,
  CASE WHEN event_id % 13 = 0 THEN 'Failed to obtain answer via API.' ELSE event_type END AS prediction,
  CASE event_id % 5 WHEN 0 THEN 'tried, All 5 retries failed.' WHEN 1 THEN 'x Failed to obtain answer via API. y' WHEN 2 THEN NULL ELSE 'fine' END AS log,
  CASE WHEN event_id % 3 = 0 THEN 'Failed to obtain answer via API.' ELSE '3' END AS res,
  CASE WHEN event_id % 7 = 0 THEN -1 ELSE 5 END AS gpt4_score
FROM {events}
"""


@query(with_view(_JUDGED_RUNS, """ SELECT model, dataset, count(*) FILTER (contains(prediction, 'Failed to obtain answer via API.')) AS failed, count(*) AS total,
      count(*) FILTER (CASE dataset WHEN 'MMVet' THEN contains(coalesce(log, ''), 'All 5 retries failed.') WHEN 'MathVista_MINI' THEN contains(res, 'Failed to obtain answer via API.')
        WHEN 'LLaVABench' THEN gpt4_score = -1 ELSE contains(coalesce(log, ''), 'Failed to obtain answer via API.') END) AS judge_failed,
      (count(*) FILTER (contains(prediction, 'Failed to obtain answer via API.')))::DOUBLE / count(*) * 100 AS failed_pct
    FROM fx GROUP BY ALL"""))
def judged_failure_scan(src: Source) -> DataFrame:
    """Failed predictions and failed judge calls per run, each data set by its own column."""
    return R.failure_scan(src.view(_JUDGED_RUNS), judged=True)


#: Data set -> family and task kind; a table of its own in real use, here as many rows as there are data sets.
_FAMILIES = {
    "choices": ("choice", "MCQ"), "yes-no": ("yes_no", "Y/N"), "MMVet-like": ("judged_unit", "VQA"), "MMBench-Video-like": ("judged_integer", "Video-VQA"),
    "consensus": ("vqa_consensus", "VQA"), "anls": ("vqa_anls", "VQA"), "exact": ("vqa_exact", "VQA"), "contained": ("containment", "VQA"),
    "charts": ("vqa_relaxed", "VQA"), "facts": ("table_truth", "VQA"), "MMLongBench-like": ("document_anls", "VQA"), "SLIDEVQA-like": ("slides", "VQA"),
    "finance": ("table_financial", "VQA"),
}
_REPLY = """CASE idx % 20 WHEN 0 THEN '0.5' WHEN 10 THEN 'fine' WHEN 1 THEN '2' ELSE 'no idea' END"""
_MATRIX = f"""WITH a AS (SELECT *, CASE idx % 10 WHEN 0 THEN 'MMVet-like' WHEN 1 THEN 'MMBench-Video-like' ELSE 'choices' END AS dataset FROM ({plain(FX.MCQ)})),
    b AS ({plain(FX.YES_NO)}), p AS ({plain(FX.VQA)}), o AS ({plain(FX.TYPED)}),
    fx AS (SELECT * FROM a WHERE dataset = 'choices'), {S.infer("fx", S.ABCD)},
    cons AS (WITH fx AS (SELECT * FROM p WHERE idx % 5 = 0), {AN._CONSENSUS} SELECT * FROM v),
    anls AS (WITH fx AS (SELECT * FROM p WHERE idx % 5 = 1), {AN._ANLS} SELECT * FROM v),
    exact AS (SELECT *, list_max(list_transform({AN._GOLDS}, lambda g: CAST({S.strip("lower(g)")} = {S.strip("lower(prediction)")} AS DOUBLE))) AS hit FROM p WHERE idx % 5 = 2),
    rel AS (WITH fx AS (SELECT * FROM p WHERE idx % 5 = 4), {AN._RELAXED} SELECT * FROM v),
    slides AS (WITH fx AS (SELECT * FROM o WHERE idx % 4 = 2), {AN._SLIDE} SELECT s.*, category FROM s JOIN o USING (idx)),
    fin AS (SELECT model, category, table_answer AS g, CASE prediction WHEN '$1,200 million' THEN 1.2e9 WHEN '12 %' THEN 12e-2 END AS a,
      CASE prediction WHEN '$1,200 million' THEN 1200.0 WHEN '12 %' THEN 12.0 END AS b FROM o WHERE idx % 4 = 3),
    r AS (
      SELECT model, 'choices' AS dataset, 'hit' AS measure, category, l2_category, CAST(coalesce(opt, 'Z') = answer AS INT)::DOUBLE AS v, 1.0 AS k FROM inferred
      UNION ALL SELECT model, dataset, 'score', category, NULL, CASE idx % 20 WHEN 0 THEN 0.5 ELSE 0.0 END, 1.0 FROM a WHERE dataset = 'MMVet-like'
      UNION ALL SELECT model, dataset, 'score', category, NULL, CASE idx % 20 WHEN 1 THEN 2.0 ELSE -1.0 END, 1.0 FROM a WHERE dataset = 'MMBench-Video-like'
      UNION ALL SELECT model, 'yes-no', 'score', category, l2_category, CAST(answer = CASE idx % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 3 THEN 'Yes' WHEN 5 THEN 'No' ELSE 'Unknown' END AS INT), 100.0 FROM b
      UNION ALL SELECT model, 'consensus', 'hit', category, NULL, hit, 100.0 FROM cons UNION ALL SELECT model, 'anls', 'hit', category, NULL, hit, 100.0 FROM anls
      UNION ALL SELECT model, 'exact', 'hit', category, NULL, hit, 100.0 FROM exact UNION ALL SELECT model, 'charts', 'hit', category, NULL, hit, 100.0 FROM rel
      UNION ALL SELECT model, 'contained', 'hit', category, NULL, CAST(contains(replace(lower(trim(prediction)), '.', ''), replace(lower(trim(model)), '.', '')) AS INT), 100.0 FROM p WHERE idx % 5 = 3
      UNION ALL SELECT model, 'facts', 'score', category, NULL, {AN._TRUTH}, 1.0 FROM o WHERE idx % 4 = 0
      UNION ALL SELECT model, 'MMLongBench-like', 'score', category, NULL, {AN._similar("lower(task)", "lower(task || category)")}, 1.0 FROM o WHERE idx % 4 = 1
      UNION ALL SELECT model, 'SLIDEVQA-like', m, category, NULL, v, 1.0 FROM (SELECT model, category, unnest(['anls', 'em', 'f1']) AS m, unnest([anls, em::DOUBLE, f1]) AS v FROM slides)
      UNION ALL SELECT model, 'finance', m, category, NULL, v, 1.0 FROM (SELECT model, category, unnest(['exact_score', 'score']) AS m, unnest([CAST(coalesce(a = CAST(g AS DOUBLE), false) AS INT)::DOUBLE,
        CAST(coalesce(a = CAST(g AS DOUBLE) OR b = CAST(g AS DOUBLE), false) AS INT)::DOUBLE]) AS v FROM fin)),
    l AS (SELECT model, dataset, measure, 'overall' AS level, 'Overall' AS key, v, k FROM r UNION ALL SELECT model, dataset, measure, 'category', category, v, k FROM r
      UNION ALL SELECT model, dataset, measure, 'l2_category', l2_category, v, k FROM r WHERE l2_category IS NOT NULL),
    d AS (SELECT unnest({[name for name in _FAMILIES]!r}) AS dataset, unnest({[f for f, _ in _FAMILIES.values()]!r}) AS family, unnest({[k for _, k in _FAMILIES.values()]!r}) AS kind)
    SELECT model, dataset, family, CASE WHEN kind IN ('MCQ', 'Y/N') THEN 'chatgpt-0125' WHEN dataset IN ('MMVet-like', 'MMBench-Video-like') THEN 'gpt-4-turbo'
      WHEN dataset IN ('MMLongBench-like', 'SLIDEVQA-like') THEN 'gpt-4o' END AS judge, measure, level, key, count(v) AS n, round(sum(v)::DOUBLE / nullif(count(v), 0) * any_value(k), 9) AS score
    FROM l JOIN d USING (dataset) WHERE key IS NOT NULL GROUP BY ALL"""


@query(_MATRIX)
def evaluate_all_runs(src: Source) -> DataFrame:
    """Thirteen families of data sets in one pass over one table of predictions, with the judge of each data set."""
    keep = ["model", "dataset", "idx", "prediction", "answer", "category"]
    choices = src.view(FX.MCQ).withColumns({
        "dataset": F.when(F.col("idx") % 10 == 0, "MMVet-like").when(F.col("idx") % 10 == 1, "MMBench-Video-like").otherwise("choices"), "reply": F.expr(_REPLY)})
    yes_no = src.view(FX.YES_NO).withColumn("dataset", F.lit("yes-no"))
    kind, charts = F.col("idx") % 5, F.col("idx") % 5 == 4
    words = src.view(FX.VQA).withColumns({
        "dataset": F.when(kind == 0, "consensus").when(kind == 1, "anls").when(kind == 2, "exact").when(kind == 3, "contained").otherwise("charts"),
        "answer": F.when(kind == 3, F.col("model")).when(charts, F.col("num_answer")).otherwise(F.col("answer")),
        "prediction": F.when(charts, F.col("num_prediction")).otherwise(F.col("prediction")),
    })
    part = F.col("idx") % 4
    pages = src.view(FX.TYPED).withColumns({
        "dataset": F.when(part == 0, "facts").when(part == 1, "MMLongBench-like").when(part == 2, "SLIDEVQA-like").otherwise("finance"),
        "prediction": F.when(part == 0, F.col("prediction")).when(part == 1, F.concat("task", "category")).when(part == 2, F.concat_ws(" ", "task", "task", "answer", "category"))
        .otherwise(F.regexp_replace("prediction", "^Answer: ", "")),
        "answer": F.when(part == 1, F.col("task")).when(part == 2, F.concat_ws(" ", "task", "category")).otherwise(F.col("table_answer")),
    })
    table = choices.select(*keep, "l2_category", *"ABCD", "reply")
    for more in (yes_no.select(*keep, "l2_category"), words.select(*keep), pages.select(*keep)):
        table = table.unionByName(more, allowMissingColumns=True)
    datasets = src.spark.createDataFrame([(name, *v) for name, v in _FAMILIES.items()], "dataset string, family string, kind string")
    return RM.evaluate_all(table, datasets).withColumn("score", F.round("score", 9))
