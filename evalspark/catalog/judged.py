"""Queries on judged scores and judge calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import answers as A
from evalspark.functions import documents as DOC
from evalspark.functions import prompts as P
from evalspark.functions import text as T
from evalspark.operators import batch as B
from evalspark.operators import scorers as SC
from evalspark.plans import choice_reports as CR
from evalspark.plans import judged_reports as R


def _judged(src: Source) -> DataFrame:
    return src.view(FX.JUDGED)


_CAPS = " UNION ALL ".join(
    f"SELECT model, 'capability' AS level, '{c}' AS key, score10 FROM fx WHERE contains(category, '{c}')" for c in K.CAPABILITIES
)


@query(with_view(FX.JUDGED, f""", l AS ({_CAPS} UNION ALL SELECT model, 'combination', replace(category, ',', '_'), score10 FROM fx
    UNION ALL SELECT model, 'overall', 'Overall', score10 FROM fx)
    SELECT model, level, key, count(*) AS tot, sum(score10)::DOUBLE / count(*) * 100 AS acc FROM l GROUP BY ALL"""))
def capability_report(src: Source) -> DataFrame:
    return R.capability(_judged(src).withColumn("score", F.col("score10")), by=("model",))


@query(with_view(FX.JUDGED, """ SELECT idx, CASE unit_reply WHEN '0.5' THEN 0.5 WHEN '1.0' THEN 1.0 WHEN '0.25' THEN 0.25 ELSE 0.0 END AS unit_score,
      CASE review WHEN '8 9' THEN 8.0 WHEN '7.5 8' THEN 7.5 ELSE -1.0 END AS first_score,
      CASE review WHEN '8 9' THEN 9.0 WHEN '7.5 8' THEN 8.0 ELSE -1.0 END AS second_score,
      CASE WHEN regexp_matches(int_reply, '^[0-9]+$') THEN CAST(int_reply AS INT) ELSE -1 END AS int_score FROM fx"""))
def judge_reply_parsing(src: Source) -> DataFrame:
    """Bounded, paired and integer judge replies."""
    rows = SC.score_judged_unit(_judged(src), "unit_reply").withColumnRenamed("score", "unit_score")
    rows = SC.score_judged_pair(rows, "review").withColumnsRenamed({"gpt4_score": "first_score", "score": "second_score"})
    rows = SC.score_judged_integer(rows, "int_reply").withColumnRenamed("score", "int_score")
    return rows.select("idx", "unit_score", "first_score", "second_score", "int_score")


@query(with_view(FX.JUDGED, """, l AS (SELECT model, 'overall' AS level, 'Overall' AS key, score10, gpt4_score FROM fx
    UNION ALL SELECT model, 'category', category, score10, gpt4_score FROM fx),
    m AS (SELECT model, level, key, count(*) AS n, sum(score10)::DOUBLE / count(*) AS s, sum(gpt4_score)::DOUBLE / count(*) AS g FROM l GROUP BY ALL)
    SELECT model, level, key, n, s / g * 100 AS relative, s * 10 AS own_score, g * 10 AS base_score FROM m"""))
def relative_score_report(src: Source) -> DataFrame:
    return R.relative_score(_judged(src).withColumn("score", F.col("score10")), by=("model",))


_DIMS = " UNION ALL ".join(
    f"SELECT model, '{d}' AS dimension, " + {"Creativity": "least(idx % 13, 10)", "Richness": "5"}.get(d, "NULL::BIGINT") + " AS v FROM fx"
    for d in K.DIALOGUE_DIMENSIONS
)


@query(with_view(FX.JUDGED, f""", l AS ({_DIMS})
    SELECT model, dimension, count(*) AS n, count(v) AS valid, coalesce(sum(v), 0)::DOUBLE / count(*) * 10 AS all_score,
      sum(v)::DOUBLE * 10 / nullif(count(v), 0) AS valid_score FROM l GROUP BY ALL"""))
def dialogue_dims(src: Source) -> DataFrame:
    return R.dialogue_dimensions(SC.score_judged_dimensions(_judged(src), "dims_reply"), by=("model",))


def _members(names: list[str]) -> str:
    return "[" + ", ".join(S.lit(x) for x in names) + "]"


_COARSE = " UNION ALL ".join(
    f"SELECT model, 'coarse' AS level, '{k}' AS key, score FROM x WHERE list_has_any(labels, {_members(v)})" for k, v in R._label_groups().items()
)


@query(with_view(FX.JUDGED, f""", x AS (SELECT model, CAST(dimensions AS JSON)::VARCHAR[] AS labels, score FROM fx),
    l AS (SELECT model, 'fine' AS level, unnest(labels) AS key, score FROM x UNION ALL {_COARSE})
    SELECT model, level, key, count(*) AS n, count(*) FILTER (score >= 0) AS valid, sum(greatest(score, 0))::DOUBLE / count(*) AS all_score,
      sum(greatest(score, 0))::DOUBLE / count(*) FILTER (score >= 0) AS valid_score FROM l GROUP BY ALL"""))
def multilabel_report(src: Source) -> DataFrame:
    return R.multi_label(_judged(src), by=("model",))


@query(with_view(FX.JUDGED, """, d AS (SELECT *, duration AS dur FROM fx UNION ALL SELECT *, 'overall' FROM fx),
    l AS (SELECT model, dur, 'overall' AS level, 'Overall' AS key, score FROM d UNION ALL SELECT model, dur, 'domain', domain, score FROM d
      UNION ALL SELECT model, dur, 'sub_category', sub_category, score FROM d UNION ALL SELECT model, dur, 'task_type', task_type, score FROM d)
    SELECT model, dur AS duration, level, key, count(*) FILTER (score >= 0) AS n, (sum(score) FILTER (score >= 0))::DOUBLE / count(*) FILTER (score >= 0) AS score
    FROM l GROUP BY ALL"""))
def duration_cube(src: Source) -> DataFrame:
    return R.duration_cube(_judged(src), by=("model",))


@query(with_view(FX.JUDGED, """, l AS (SELECT model, 'overall' AS level, 'Overall' AS key, score FROM fx UNION ALL SELECT model, 'task', task_type, score FROM fx)
    SELECT model, level, key, count(*) FILTER (score <> 0) AS hits, count(*) AS total, (count(*) FILTER (score <> 0))::DOUBLE / count(*) * 100 AS pct
    FROM l GROUP BY ALL"""))
def task_board(src: Source) -> DataFrame:
    return R.task_board(_judged(src), by=("model",))


# ------------------------------------------------------------------ judge calls
def _stub_judge(prompt: str, temperature: float = 0.0) -> str:
    """Stand-in for a model: answers only when asked with some temperature, by prompt length."""
    if temperature < 0.5:
        return K.FAIL_MESSAGE
    return "ABCZ"[len(prompt) % 4]


ABCD = {c: c for c in "ABCD"}


@query()
def judge_batch(src: Source) -> DataFrame:
    """Rows that rules cannot decide go to the judge, with one retry; all rows come back."""
    rows = SC.score_options(src.view(FX.MCQ).withColumn("gt", F.col("answer")), ABCD)
    prompted = rows.withColumn("prompt", P.option_judge("question", A.option_map(ABCD), "prediction")).select(
        "idx", "model", "split", "gt", "opt", "prompt", *ABCD
    )
    asked = B.judge_unresolved(prompted, F.col("opt").isNull(), _stub_judge, tries=3)
    judged = F.coalesce("opt", A.infer_option("reply", ABCD, ""), SC.guess_option(F.col("idx"), A.present_letters(ABCD)))
    return asked.select("idx", "model", judged.alias("opt"), "tries", CR.letter_hit(judged, F.col("gt")).alias("hit"))


@query(with_view(FX.JUDGED, """ SELECT idx, 'extracted' AS kind, CASE idx % 3 WHEN 0 THEN category WHEN 1 THEN '' ELSE task_type END AS value FROM fx"""))
def extracted_answer_parsing(src: Source) -> DataFrame:
    """Answer lines of document judge replies."""
    reply = (
        F.when(F.col("idx") % 3 == 0, F.concat(F.lit("Extracted answer: "), "category", F.lit("\nAnswer format: Str")))
        .when(F.col("idx") % 3 == 1, F.col("review"))
        .otherwise(F.concat(F.lit("Analysis\nExtracted answer:\t"), "task_type", F.lit(" \nAnswer format: List\nExtracted answer: no")))
    )
    return _judged(src).select("idx", F.lit("extracted").alias("kind"), DOC.extracted_answer(reply).alias("value"))


@query(with_view(FX.MCQ, f""", p AS (SELECT *, coalesce(prediction, '') AS pr, 'There are several options: ' || chr(10)
      || coalesce('A. ' || A || chr(10), '') || coalesce('B. ' || B || chr(10), '') || coalesce('C. ' || C || chr(10), '') || coalesce('D. ' || D || chr(10), '') AS ob FROM fx)
    SELECT idx, length({S.lit(P._OPTION_JUDGE["en"])} || 'Question: ' || question || chr(10) || 'Options: ' || ob || chr(10) || 'Reply: ' || pr || chr(10) || 'Letter: ') AS option_chars,
      length({S.lit(P._YES_NO_JUDGE)} || 'Question: ' || question || chr(10) || 'Reply: ' || pr || chr(10) || 'Word: ') AS yes_no_chars,
      md5({S.lit(P._OPEN_SCORE_JUDGE)} || 'Question: ' || question || chr(10) || 'Expected: ' || A || ' <AND> ' || B || chr(10) || 'Reply: ' || pr || chr(10) || 'Score: ') AS open_digest,
      md5({S.lit(P._VIDEO_JUDGE)} || 'Question: ' || question || chr(10) || 'Expected: ' || answer || chr(10) || 'Reply: ' || pr || chr(10) || 'Number: ') AS video_digest
    FROM p"""))
def judge_prompts(src: Source) -> DataFrame:
    rows = src.view(FX.MCQ)
    option = P.option_judge("question", A.option_map(ABCD), "prediction")
    open_score = P.open_score_judge("question", F.concat("A", F.lit("<AND>"), "B"), "prediction")
    video = P.video_judge("question", "answer", "prediction")
    return rows.select(
        "idx", F.length(option).cast("bigint").alias("option_chars"),
        F.length(P.yes_no_judge("question", "prediction")).cast("bigint").alias("yes_no_chars"),
        F.md5(open_score.cast("binary")).alias("open_digest"), F.md5(video.cast("binary")).alias("video_digest"),
    )


@query(with_view(FX.MCQ, "," + S.infer("fx", S.ABCD) + """
    SELECT idx AS id, CASE WHEN A IS NOT NULL THEN coalesce(opt, 'false') ELSE prediction END AS answer FROM inferred"""))
def submission_export(src: Source) -> DataFrame:
    from evalspark.sources import tables as TB

    return TB.submission_options(src.view(FX.MCQ), ABCD, "idx").withColumnRenamed("idx", "id")


@query(with_view(FX.MCQ, "," + S.infer("fx", S.ABCD) + f"""
    SELECT idx, split, coalesce(opt, 'Z') AS opt, CASE WHEN opt IS NULL THEN {S.lit(K.NO_JUDGE_LOG)} ELSE p0 END AS log FROM inferred"""))
def submission_log_table(src: Source) -> DataFrame:
    from evalspark.sources import tables as TB

    return TB.submission_table(src.view(FX.MCQ), ABCD).select("idx", "split", "opt", "log")


@query(with_view(FX.JUDGED, """ SELECT idx, contains(review, 'bad') OR contains(review, '8') AS listed,
      contains(review, 'sorry') OR contains(category, 'I can''t') AS refused, regexp_matches(category, '[一-鿿]') AS cjk FROM fx"""))
def text_predicates(src: Source) -> DataFrame:
    needles = F.array(F.lit("bad"), F.lit("8"))
    refused = T.is_refusal("review") | T.is_refusal("category")
    return _judged(src).select("idx", T.list_in_text(needles, "review").alias("listed"), refused.alias("refused"), T.has_cjk("category").alias("cjk"))
