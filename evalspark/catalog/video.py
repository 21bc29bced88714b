"""Video queries: subtitles, frame numbers, options, packs of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, plain, query, with_view
from evalspark.functions import answers as A
from evalspark.functions import json_text as J
from evalspark.functions import text as T
from evalspark.operators import expand as E
from evalspark.operators import intervals as I
from evalspark.operators import scorers as SC
from evalspark.plans import run_reports as RR


@query(f"""WITH s AS ({plain(FX.SUBTITLES)}), f AS ({plain(FX.FRAMES)}),
    h AS (SELECT f.frame_id, arg_min(s.text, s.pos) AS text FROM f JOIN s ON f.video = s.video AND s.start_ms < f.t_ms AND f.t_ms < s.end_ms GROUP BY 1)
    SELECT f.frame_id, f.video, f.t_ms, CASE WHEN trim(replace(h.text, '\\N', ' ')) <> '' THEN replace(h.text, '\\N', ' ') END AS subtitle
    FROM f LEFT JOIN h ON f.frame_id = h.frame_id""")
def subtitle_interval_join(src: Source) -> DataFrame:
    """First subtitle, in file order, around every frame time."""
    frames = src.view(FX.FRAMES).select("frame_id", "video", "t_ms")
    return I.frame_subtitles(frames, src.view(FX.SUBTITLES))


@query(f"""WITH s AS ({plain(FX.SUBTITLES)}), f AS ({plain(FX.FRAMES)}),
    k AS (SELECT frame_id, video, unnest(range(1, 5)) AS frame_no, n_frames FROM f),
    t AS (SELECT frame_id, video, frame_no, CAST(FLOOR(frame_no * (n_frames::DOUBLE / 5)) AS BIGINT) * 97 AS t_ms FROM k),
    h AS (SELECT t.frame_id, t.frame_no, arg_min(s.text, s.pos) AS text FROM t JOIN s ON t.video = s.video AND s.start_ms < t.t_ms AND t.t_ms < s.end_ms GROUP BY 1, 2),
    l AS (SELECT frame_id, frame_no, replace(text, '\\N', ' ') AS line FROM h WHERE trim(replace(text, '\\N', ' ')) <> '')
    SELECT f.frame_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.frame_no), '') AS subtitles FROM f LEFT JOIN l ON f.frame_id = l.frame_id GROUP BY 1""")
def prompt_subtitles(src: Source) -> DataFrame:
    """Subtitle block of four sampled frames per clip."""
    clips = src.view(FX.FRAMES).select("frame_id", "video", F.posexplode(E.uniform_frames("n_frames", 4)).alias("frame_no", "frame"))
    frames = clips.withColumn("t_ms", F.col("frame").cast("bigint") * 97)
    return I.prompt_subtitles(frames, src.view(FX.SUBTITLES), ["frame_id"])


@query(with_view(FX.FRAMES, """,
    b AS (SELECT *, CASE WHEN frame_id % 3 = 0 THEN NULL ELSE (frame_id % 7)::DOUBLE END AS st, CASE WHEN frame_id % 3 = 0 THEN NULL ELSE (frame_id % 7 + 5)::DOUBLE END AS en FROM fx),
    c AS (SELECT *, CASE WHEN st IS NULL THEN 0.0 ELSE greatest(0.0, st * 25.0) END AS lo,
      least(CASE WHEN en IS NULL THEN 2500000.0 ELSE en * 25.0 END, n_frames::DOUBLE) AS hi FROM b)
    SELECT frame_id, array_to_string(list_transform(range(1, 9), lambda i: CAST(FLOOR(i * (n_frames::DOUBLE / 9)) AS BIGINT)), ',') AS uniform,
      array_to_string(list_transform(range(0, 8), lambda i: CAST(FLOOR(n_frames::DOUBLE / 8 / 2 + round_even(n_frames::DOUBLE / 8 * i, 0)) AS BIGINT)), ',') AS segment,
      array_to_string(list_transform(range(0, 4), lambda i: CAST(trunc(lo + (hi - lo) / 4 / 2 + round_even((hi - lo) / 4 * i, 0)) AS BIGINT)), ',') AS bounded
    FROM c"""))
def frame_sampling(src: Source) -> DataFrame:
    rows = src.view(FX.FRAMES)
    free = F.col("frame_id") % 3 == 0
    start = F.when(~free, (F.col("frame_id") % 7).cast("double"))
    bounded = E.segment_frames("n_frames", 4, F.lit(25.0), start, start + 5)
    texts = {"uniform": E.uniform_frames("n_frames", 8), "segment": E.segment_frames("n_frames", 8), "bounded": bounded}
    return rows.select("frame_id", *[F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in texts.items()])


_LETTER_AD = "".join("replace(" for _ in K.LEAD_INS_AD) + S.strip("coalesce(prediction, 'nan')") + "".join(f", {S.lit(s)}, '')" for s in K.LEAD_INS_AD)


@query(with_view(FX.MCQ, f""", q AS (SELECT idx, answer, lower(prediction) AS prediction, upper(A) AS A, B, C, D FROM fx), {S.infer("q", {"A": "trim(A)", "B": "trim(B)", "C": "trim(C)", "D": "trim(D)"})},
    e AS (SELECT idx, answer, coalesce(nullif(regexp_extract({_LETTER_AD}, '[ABCD]'), ''), opt, 'Z') AS extracted FROM inferred)
    SELECT idx, extracted, CAST(extracted = answer AS INT) AS score FROM e"""))
def video_choice_score(src: Source) -> DataFrame:
    """Letters read from lower-cased replies and from the options written in the question."""
    rows = src.view(FX.MCQ)
    lines = [F.concat(F.lit(f"{c}. "), F.upper("A") if c == "A" else F.col(c)) for c in "ABCD"]
    asked = rows.withColumns({"question": F.concat_ws("\n", "question", *lines), "prediction": F.lower("prediction")})
    return SC.score_video_choice(asked).select("idx", "extracted", "score")


@query(with_view(FX.MCQ, """, v AS (SELECT idx, A, B, C, CASE answer WHEN 'A' THEN A WHEN 'B' THEN B ELSE C END AS gold, answer,
      CASE idx % 5 WHEN 0 THEN '(' || answer || ') yes' WHEN 1 THEN 'b. maybe' WHEN 2 THEN 'Failed to obtain answer via API.' WHEN 3 THEN B ELSE 'none' END AS prediction FROM fx),""" + S.infer("v", {c: c for c in "ABC"}) + """,
    h AS (SELECT *, '(' || answer || ') ' || gold AS ga, string_split(lower(prediction), ' ')[1] AS ph FROM inferred)
    SELECT idx, ga AS gold, CASE WHEN contains(prediction, 'Failed to obtain answer via API.') THEN -1
      WHEN contains(lower('(' || answer || ')'), replace(ph, '.', '')) OR contains(ph, lower('(' || answer || ')')) OR coalesce(opt = answer, false) THEN 1 ELSE 0 END AS score FROM h"""))
def video_option_score(src: Source) -> DataFrame:
    """Candidates as lettered options; the head of the reply, else its inferred letter, decides."""
    rows = src.view(FX.MCQ)
    gold = F.when(F.col("answer") == "A", F.col("A")).when(F.col("answer") == "B", F.col("B")).otherwise(F.col("C"))
    kind = F.col("idx") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("("), "answer", F.lit(") yes"))).when(kind == 1, "b. maybe")
        .when(kind == 2, K.FAIL_MESSAGE).when(kind == 3, F.col("B")).otherwise("none")
    )
    asked = rows.withColumns({"candidates": F.to_json(F.array("A", "B", "C")), "prediction": reply, "answer": gold})
    lettered = A.lettered_candidates(T.list_or_empty("candidates"), "answer")[1]
    return SC.score_video_options(asked).select("idx", lettered.alias("gold"), "score")


@query(with_view(FX.MCQ, """, v AS (SELECT idx, answer || '. ' || CAST(idx % 12 AS VARCHAR) AS gold,
      CASE idx % 4 WHEN 0 THEN 'It is three.' WHEN 1 THEN lower(answer) || '. x' WHEN 2 THEN 'seven' ELSE CAST(idx % 12 AS VARCHAR) END AS pred FROM fx),
    w AS (SELECT *, string_split(lower(pred), ' ')[1] AS ph, string_split(lower(gold), ' ')[1] AS gh, string_split(gold, ' ')[2] AS gc FROM v)
    SELECT idx, contains(gh, replace(ph, '.', '')) OR contains(ph, gh) AS plain_match,
      contains(gh, replace(ph, '.', '')) OR contains(ph, gh) OR contains(trim(lower(pred), '. '), coalesce(['zero','one','two','three','four','five','six','seven','eight','nine'][CAST(gc AS INT) + 1], gc)) AS full_match
    FROM w"""))
def option_head_match(src: Source) -> DataFrame:
    rows = src.view(FX.MCQ)
    number = (F.col("idx") % 12).cast("string")
    kind = F.col("idx") % 4
    pred = F.when(kind == 0, "It is three.").when(kind == 1, F.concat(F.lower("answer"), F.lit(". x"))).when(kind == 2, "seven").otherwise(number)
    both = rows.select("idx", F.concat("answer", F.lit(". "), number).alias("gold"), pred.alias("pred"))
    return both.select("idx", A.option_match("pred", "gold").alias("plain_match"), A.option_match_advanced("pred", "gold").alias("full_match"))


_REPLY_CASE = """CASE c_custkey % 4 WHEN 0 THEN 'Failed to obtain answer via API.' WHEN 1 THEN 'Sure: {{"0": "' || c_mktsegment || '", "1": 7}} done'
    WHEN 2 THEN 'Here {{ "0": "' || c_name || '",' || chr(10) || ' "2": "two"' ELSE 'no object' END"""
_PACKS = f"SELECT c_custkey AS video, {_REPLY_CASE} AS reply FROM {{customer}}"
_QUESTIONS = "SELECT o_custkey AS video, o_orderkey AS qid, o_orderkey % 3 AS idx FROM {orders}"
_ANSWERED = f"""WITH p AS (SELECT c_custkey AS video, c_custkey % 4 AS k, c_mktsegment, c_name FROM customer), q AS ({plain(_QUESTIONS)}),
    a AS (SELECT q.qid, q.video, q.idx, CASE WHEN k = 1 AND idx = 0 THEN c_mktsegment WHEN k = 1 AND idx = 1 THEN '7'
      WHEN k = 2 AND idx = 0 THEN c_name WHEN k = 2 AND idx = 2 THEN 'two' END AS prediction FROM q LEFT JOIN p ON q.video = p.video)"""


def _packs(src: Source) -> tuple[DataFrame, DataFrame]:
    packs = src.view(_PACKS).withColumn("answers", J.answer_map("reply"))
    questions = src.view(_QUESTIONS).withColumn("index", F.col("idx"))
    return packs, RR.attach_pack_answers(questions, packs)


@query(_ANSWERED + " SELECT qid, video, idx, prediction FROM a")
def pack_answers(src: Source) -> DataFrame:
    """Answers looked up in the object each pack reply holds."""
    return _packs(src)[1].select("qid", "video", "idx", "prediction")


@query(_ANSWERED + """ SELECT * FROM (SELECT count(*) FILTER (k = 0) AS GEN_FAIL, count(*) FILTER (k IN (1, 2)) AS PARSE_OK, count(*) FILTER (k = 3) AS PARSE_FAIL FROM p),
    (SELECT count(prediction) AS VALIDQ, count(*) - count(prediction) AS INVALIDQ FROM a)""")
def pack_statistics(src: Source) -> DataFrame:
    return RR.pack_statistics(*_packs(src))


@query("""SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_id AS "index", event_type AS question FROM events""")
def pack_questions(src: Source) -> DataFrame:
    """Questions of each video with their positions."""
    events = src.table("events").select(F.col("user_id").alias("video"), F.col("event_id").alias("index"), F.col("event_type").alias("question"))
    return E.pack_questions(events)


@query("""WITH q AS (SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS pack FROM events)
    SELECT user_id AS video, pack, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR) || '=' || event_type, ';' ORDER BY event_id)) AS digest
    FROM q GROUP BY ALL""")
def pack_prompts(src: Source) -> DataFrame:
    """Fifty questions of a video to a map."""
    events = src.table("events").select(F.col("user_id").alias("video"), F.col("event_id").alias("index"), F.col("event_type").alias("question"))
    packs = E.pack_maps(E.pack_questions(events), ["video"], F.floor(F.col("position") / 50))
    listed = F.transform(F.map_entries("questions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return packs.select("video", "pack", F.size("questions").cast("bigint").alias("n"), F.md5(F.array_join(listed, ";").cast("binary")).alias("digest"))
