"""Queries on judge requests and on replies that come as a table built from the given data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, query, with_view
from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import prompts as P
from evalspark.operators import keys as OK
from evalspark.operators import replies as RP
from evalspark.operators import scorers as SC
from evalspark.plans import choice_reports as R
from evalspark.plans import grouping as G
from evalspark.plans import judged_reports as JR

ABCD = {c: c for c in "ABCD"}
_OFFSET = 1_000_000_000_000

_CHOICE_REPLIES = """
SELECT event_id AS idx, CASE event_id % 5 WHEN 0 THEN substr('ABCD', CAST(event_id % 4 AS INT) + 1, 1) WHEN 1 THEN 'The letter is B.'
  WHEN 2 THEN 'Z' WHEN 3 THEN 'either A or C' END AS reply FROM {events} WHERE event_id % 5 < 4
"""
_YES_NO_REPLIES = """
SELECT doc_id AS idx, CASE doc_id % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'It says no' ELSE 'hard to tell' END AS reply FROM {labels}
"""
_SCORE_REPLIES = """
SELECT event_id AS idx, CASE event_id % 5 WHEN 0 THEN '1.0' WHEN 1 THEN '0.5' WHEN 2 THEN 'fine' WHEN 3 THEN '7' END AS reply
FROM {events} WHERE event_id % 5 < 4
"""
_OPEN_MCQ = S.infer("fx", S.ABCD)


@query(with_view(FX.MCQ, f""", {_OPEN_MCQ}
    SELECT DISTINCT 'choice' AS kind, model, idx, true AS asks_all FROM inferred WHERE opt IS NULL"""))
def judge_requests(src: Source) -> DataFrame:
    """What a judge is to be asked about choice rows that rules leave open; prompts hold question and prediction."""
    rows = SC.score_options(src.view(FX.MCQ).withColumn("gt", F.col("answer")), ABCD)
    prompt = P.option_judge("question", A.option_map(ABCD), "prediction")
    asked = RP.requests(rows, "choice", ["model", "idx"], prompt, F.col("opt").isNull())
    held = rows.select("model", "idx", "question", "prediction").join(asked, ["model", "idx"])
    said = F.contains("prompt", F.col("question")) & F.contains("prompt", F.coalesce("prediction", F.lit("")))
    return held.select("kind", "model", "idx", said.alias("asks_all")).distinct()


_POOL = "list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in "ABCD") + ", 'Z'], lambda x: x IS NOT NULL)"
_REPLY_LETTER = """CASE idx % 5 WHEN 0 THEN CASE WHEN idx % 4 < 3 OR D IS NOT NULL THEN substr('ABCD', CAST(idx % 4 AS INT) + 1, 1) END
    WHEN 1 THEN 'B' WHEN 2 THEN 'Z' END"""


@query(with_view(FX.MCQ, f""", {_OPEN_MCQ},
    z AS (SELECT *, {_POOL} AS pool, ('0x' || substr(md5(CAST(idx AS VARCHAR)), 1, 8))::BIGINT AS number FROM inferred),
    j AS (SELECT *, coalesce(opt, {_REPLY_LETTER}, pool[number % len(pool) + 1]) AS final FROM z),
    sc AS (SELECT *, CAST(final = answer AS INT) AS hit FROM j) """ + S.means("sc", "model, split", {"overall": None, "l2_category": "l2_category", "category": "category"}, "hit")))
def judged_choice_report(src: Source) -> DataFrame:
    """Accuracy after judge replies: the rule's letter, else the reply's, else a stable guess."""
    rows = SC.score_options(src.view(FX.MCQ).withColumn("gt", F.col("answer")), ABCD)
    joined = RP.attach_replies(rows, src.view(_CHOICE_REPLIES), ["idx"])
    return R.accuracy(RP.rescore_options(joined, ABCD, "idx"), by=("model",))


@query(with_view(FX.YES_NO, """,
    e AS (SELECT *, CASE idx % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 3 THEN 'Yes' WHEN 5 THEN 'No' END AS rule FROM fx),
    f AS (SELECT *, coalesce(rule, CASE idx % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END) AS extracted FROM e),
    s AS (SELECT *, CAST(extracted = answer AS INT) AS score FROM f) """ + S.means("s", "model", {"overall": None, "category": "category", "l2_category": "l2_category"}, "score", "100.0")))
def judged_yesno_report(src: Source) -> DataFrame:
    """Accuracy where Unknown rows take what the judge's reply says."""
    rows = SC.score_yes_no(src.view(FX.YES_NO))
    return R.yes_no_accuracy(RP.rescore_yes_no(RP.attach_replies(rows, src.view(_YES_NO_REPLIES), ["idx"])), by=("model",))


@query(with_view(FX.CIRCULAR, "," + S.infer("fx", S.ABCD) + """,
    g AS (SELECT *, idx % 1000000000000 AS gid, CAST(FLOOR(idx / 1000000000000) AS BIGINT) AS rolling FROM inferred),
    h AS (SELECT *, coalesce(opt, CASE WHEN prediction = 'not sure' THEN CASE WHEN rolling % 2 = 0 THEN answer ELSE 'A' END END) AS final FROM g)
    SELECT model, gid AS idx, CAST(bool_and(coalesce(final = answer, false)) AS INT) AS hit, count(*) AS n, count(*) FILTER (final IS NULL) AS n_open
    FROM h GROUP BY ALL"""))
def judged_circular(src: Source) -> DataFrame:
    """Question groups scored with the replies of their open rotations."""
    rows = src.view(FX.CIRCULAR)
    replies = rows.where("prediction = 'not sure'").select(
        "model", "idx", F.when(OK.rotation("idx", _OFFSET) % 2 == 0, F.concat(F.lit("Option "), "answer")).otherwise("A").alias("reply"))
    joined = RP.attach_replies(rows.withColumn("gt", F.col("answer")), replies, ["model", "idx"])
    return RP.rescore_circular(joined, ABCD, by=("model",), index="idx", offset=_OFFSET).select("model", "idx", "hit", "n", "n_open")


@query(with_view(FX.CIRCULAR, "," + S.infer("fx", S.ABCD) + """,
    g AS (SELECT *, idx % 1000000000000 AS gid FROM inferred),
    w AS (SELECT model, gid FROM g GROUP BY ALL HAVING NOT bool_or(opt IS NOT NULL AND opt <> answer) AND bool_or(opt IS NULL))
    SELECT model, idx FROM g WHERE opt IS NULL AND (model, gid) IN (SELECT (model, gid) FROM w)"""))
def judge_circular_requests(src: Source) -> DataFrame:
    """Open rotations of groups that a judge can still turn into a hit."""
    return RP.open_rotations(src.view(FX.CIRCULAR).withColumn("gt", F.col("answer")), ABCD, by=("model",), index="idx", offset=_OFFSET).select("model", "idx")


@query(with_view(FX.JUDGED, """, r AS (SELECT *, CASE idx % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS unit FROM fx)
    SELECT model, count(*) AS n, round(avg(unit::DOUBLE), 9) AS score FROM r GROUP BY ALL"""))
def judged_unit_report(src: Source) -> DataFrame:
    """Mean of bounded scores read from a table of replies; rows without a readable reply score 0."""
    rows = RP.attach_replies(src.view(FX.JUDGED).drop("score"), src.view(_SCORE_REPLIES), ["idx"])
    scored = SC.score_judged_unit(rows)
    return scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("score"))


#: Replies about single turns, some with a word about it, as numbers or as texts, above ten, or without scores; a quarter of the turns has none.
_TURN_REPLIES = """
SELECT event_id AS idx, CAST(t AS INT) AS turn, CASE (event_id + t) % 4
  WHEN 0 THEN 'Well. {{"Creativity": ' || CAST((event_id + t) % 13 AS STRING) || ', "Overall Score": 7}}' WHEN 1 THEN 'no scores'
  ELSE '{{"Richness": "8.6", "Creativity": 3}}' END AS reply
FROM {events} LATERAL VIEW explode(array(0, 1, 2)) x AS t WHERE (event_id + t) % 4 < 3
"""
_TURN_SCORES = " UNION ALL ".join(
    f"SELECT model, '{d}' AS dimension, {v} AS v FROM tn" for d, v in {
        **dict.fromkeys(K.DIALOGUE_DIMENSIONS, "NULL::BIGINT"), "Creativity": "CASE k WHEN 0 THEN least((event_id + t) % 13, 10) WHEN 2 THEN 3 END",
        "Richness": "CASE k WHEN 2 THEN 8 END", "Overall Score": "CASE k WHEN 0 THEN 7 END"}.items()
)


@query(f"""WITH tn AS (SELECT event_id, 'm' || CAST(user_id % 3 AS VARCHAR) AS model, t, (event_id + t) % 4 AS k
      FROM (SELECT *, unnest(range(0, 1 + event_id % 3)) AS t FROM events)), l AS ({_TURN_SCORES})
    SELECT model, dimension, count(*) AS n, count(v) AS valid, round(coalesce(sum(v), 0)::DOUBLE / count(*) * 10, 9) AS all_score,
      round(sum(v)::DOUBLE * 10 / nullif(count(v), 0), 9) AS valid_score, any_value(asked) AS asked
    FROM l JOIN (SELECT model, count(*) AS asked FROM tn GROUP BY model) USING (model) GROUP BY ALL""")
def judged_dialogue_report(src: Source) -> DataFrame:
    """Dialogues judged turn by turn: requests by dialogue and turn, replies joined back, and dimensions summed up again per model."""
    turns = RP.explode_dialogues(src.view(FX.DIALOGUES), ["model", "idx"])
    asked = RP.dialogue_requests(turns, ["model", "idx"]).groupBy("model").agg(F.count(F.lit(1)).alias("asked"))
    joined = RP.attach_replies(turns, src.view(_TURN_REPLIES), ["idx", "turn"])
    report = JR.dialogue_dimensions(SC.score_judged_dimensions(joined), by=("model",))
    return report.join(asked, "model").select("model", "dimension", "n", "valid", F.round("all_score", 9).alias("all_score"), F.round("valid_score", 9).alias("valid_score"), "asked")


_PAIR_REPLIES = """
SELECT event_id AS idx, CASE event_id % 6 WHEN 0 THEN '8 9' WHEN 1 THEN '8, 9' WHEN 2 THEN '7' WHEN 3 THEN '7.5 8' WHEN 4 THEN '6 3' || chr(10) || 'The second is short.' END AS reply
FROM {events} WHERE event_id % 6 < 5
"""


@query(with_view(FX.JUDGED, """, s AS (SELECT model, category, CASE idx % 6 WHEN 0 THEN 8.0 WHEN 3 THEN 7.5 WHEN 4 THEN 6.0 ELSE -1.0 END::DOUBLE AS g,
      CASE idx % 6 WHEN 0 THEN 9.0 WHEN 3 THEN 8.0 WHEN 4 THEN 3.0 ELSE -1.0 END::DOUBLE AS o FROM fx),
    l AS (SELECT model, 'overall' AS level, 'Overall' AS key, g, o FROM s UNION ALL SELECT model, 'category', category, g, o FROM s),
    m AS (SELECT model, level, key, count(*) AS n, sum(o) / count(*) AS s, sum(g) / count(*) AS g FROM l GROUP BY ALL)
    SELECT model, level, key, n, round(s / g * 100, 9) AS relative, round(s * 10, 9) AS own_score, round(g * 10, 9) AS base_score FROM m"""))
def judged_pair_report(src: Source) -> DataFrame:
    """Replies judged beside a baseline's: what is asked is keyed by row, and two numbers are read from what comes back."""
    rows = src.view(FX.JUDGED).drop("score", "gpt4_score").withColumns({"caption": F.col("task_type"), "question": F.col("domain"), "answer": F.col("dimensions"), "prediction": F.col("dims_reply")})
    asked = RP.pair_requests(rows, ["model", "idx"]).select("model", "idx")
    joined = RP.attach_replies(rows.join(asked, ["model", "idx"]), src.view(_PAIR_REPLIES), ["idx"])
    report = JR.relative_score(SC.score_judged_pair(joined), by=("model",))
    return report.select("model", "level", "key", "n", *[F.round(c, 9).alias(c) for c in ("relative", "own_score", "base_score")])


_VIDEO_REPLIES = """
SELECT event_id AS idx, CASE event_id % 7 WHEN 0 THEN 'no idea' WHEN 1 THEN '2.0' ELSE CAST(event_id % 4 AS STRING) END AS reply FROM {events} WHERE event_id % 7 <> 2
"""


@query(with_view(FX.JUDGED, """, s AS (SELECT model, duration, CASE WHEN idx % 7 IN (0, 1, 2) THEN -1 ELSE idx % 4 END AS score FROM fx),
    l AS (SELECT model, 'overall' AS level, 'Overall' AS key, score FROM s UNION ALL SELECT model, 'duration', duration, score FROM s)
    SELECT model, level, key, count(*) AS n, sum(score)::DOUBLE / count(*) AS score FROM l GROUP BY ALL"""))
def judged_video_report(src: Source) -> DataFrame:
    """Answers judged 0 to 3; no reply, or anything else, is -1."""
    rows = src.view(FX.JUDGED).drop("score").withColumns({"question": F.col("domain"), "answer": F.col("task_type"), "prediction": F.col("unit_reply")})
    asked = RP.video_requests(rows, ["model", "idx"]).select("model", "idx")
    joined = RP.attach_replies(rows.join(asked, ["model", "idx"]), src.view(_VIDEO_REPLIES), ["idx"])
    return G.level_means(SC.score_judged_integer(joined), ("model",), {"overall": None, "duration": "duration"}, "score")
