"""Queries on prompts, dialogues, token budgets, batch calls and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark import session
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import messages as M
from evalspark.functions import numbers as N
from evalspark.functions import prompts as P
from evalspark.operators import batch as B
from evalspark.operators import expand as E
from evalspark.operators import scorers as SC
from evalspark.streaming import incremental as INC

ABCD = {c: c for c in "ABCD"}
_NL = "chr(10)"
_OPTION_LINES = " || ".join(f"coalesce('{c}. ' || {c} || chr(10), '')" for c in "ABCD")
_PRESENT = "coalesce(A, B, C, D) IS NOT NULL"


def _mcq(src: Source) -> DataFrame:
    hint = F.when(F.col("idx") % 2 == 0, F.col("category"))
    return src.view(FX.MCQ).withColumn("hint", hint)


_HINT = "coalesce('Hint: ' || CASE WHEN idx % 2 = 0 THEN category END || chr(10), '')"


@query(with_view(FX.MCQ, f""" SELECT idx, 'image=' || CAST(idx AS VARCHAR) || '.jpg | text=' || {_HINT} || 'Question: ' || question || {_NL}
    || 'Options:' || {_NL} || {_OPTION_LINES} || {S.lit(K.SELECT_OPTION)} AS prompt FROM fx"""))
def prompt_mcq(src: Source) -> DataFrame:
    images = F.array(F.concat(F.col("idx").cast("string"), F.lit(".jpg")))
    message = M.base_message(images, M.mcq_text("question", ABCD, "hint"))
    return _mcq(src).select("idx", M.as_text_log(message).alias("prompt"))


@query(with_view(FX.MCQ, f""" SELECT idx, 'text=' || question || ' at  | image=a | text= and  | image=b | text=' || {_NL} || 'A. ' || A || {_NL} || 'B. ' || B || {_NL} || 'C. ' || C
    || coalesce({_NL} || 'D. ' || D, '') || {S.lit(K.LETTER_ONLY)} AS prompt FROM fx"""))
def prompt_multi_image(src: Source) -> DataFrame:
    rows = src.view(FX.MCQ).withColumn("question", F.concat("question", F.lit(" at <image> and <image>")))
    message = M.ordered_images(F.array(F.lit("a"), F.lit("b")), M.multi_image_text("question", ABCD))
    return rows.select("idx", M.as_text_log(message).alias("prompt"))


@query(with_view(FX.MCQ, """ SELECT idx, CASE WHEN idx % 3 = 0 THEN 'image=a | image=b | text=' || question
    ELSE 'text=See  | image=b | text= then  | image=a | text=: ' || question END AS prompt FROM fx"""))
def prompt_inline_images(src: Source) -> DataFrame:
    text = F.when(F.col("idx") % 3 == 0, F.col("question")).otherwise(F.concat(F.lit("See <image 2> then <image 1>: "), "question"))
    message = M.numbered_images(F.array(F.lit("a"), F.lit("b")), text)
    return src.view(FX.MCQ).select("idx", M.as_text_log(message).alias("prompt"))


_TEMPLATES = {
    "fintabnetqa": "Answer with the unit.\nQuestion: {question}\nAnswer:", "vtabfact": "True or false?\nStatement: {question}\nAnswer:",
    "vwtq": "Answer from the table.\nQuestion: {question}\nAnswer:", "vwtq_syn": "Answer from the table.\nQuestion: {question}\nAnswer:",
}
_TEMPLATE_CASE = "CASE split " + " ".join(
    f"WHEN '{k}' THEN {S.lit(v.split('{question}')[0])} || task || {S.lit(v.split('{question}')[1])}" for k, v in _TEMPLATES.items()
) + " END"


@query(with_view(FX.TYPED, f""" SELECT idx, {_TEMPLATE_CASE} AS table_prompt, task || {S.lit(K.SHORT_ANSWER_SUFFIX)} AS short_prompt,
    task || {S.lit(K.SAME_LANGUAGE_SUFFIX)} AS language_prompt, task || ' ' || category || {_NL} || {S.lit(K.REAL_WORLD_INSTRUCTION["cn"])} AS real_prompt FROM fx"""))
def prompt_vqa(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED)
    return rows.select(
        "idx", M.table_text("split", "task", _TEMPLATES).alias("table_prompt"), F.concat("task", F.lit(K.SHORT_ANSWER_SUFFIX)).alias("short_prompt"),
        F.concat("task", F.lit(K.SAME_LANGUAGE_SUFFIX)).alias("language_prompt"), M.real_world_text("task", "category", "cn").alias("real_prompt"),
    )


_CASES = """CASE idx % 8 WHEN 0 THEN 'MMMU_x' WHEN 1 THEN 'plain' WHEN 2 THEN 'ChartQA_x' WHEN 3 THEN 'HallusionBench' WHEN 4 THEN 'MMVet' WHEN 5 THEN 'OCRBench'
  WHEN 6 THEN 'MMStar' ELSE 'other' END"""
_KINDS = """CASE idx % 8 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'MCQ' WHEN 2 THEN 'VQA' WHEN 3 THEN 'Y/N' WHEN 4 THEN 'VQA' WHEN 5 THEN 'VQA' WHEN 6 THEN 'MCQ' ELSE 'Y/N' END"""
#: Every third row has no options; every fifth question is in Chinese.
_ASKED = "*, CASE WHEN idx % 5 = 0 THEN '问题 ' ELSE '' END || question AS q, " + ", ".join(f"CASE WHEN idx % 3 > 0 THEN {c} END AS {c}1" for c in "ABCD")
_LINES1 = " || ".join(f"coalesce('{c}. ' || {c}1 || chr(10), '')" for c in "ABCD")
_LABELLED = f"{_HINT} || 'Question: ' || q || {_NL} || CASE WHEN idx % 3 > 0 THEN 'Options:' || {_NL} || {_LINES1} ELSE '' END"
_STEP = "Read the following question carefully, solve it step by step, and then output the final answer in the format of \"Answer: single number or single word or phrase\".\n\n"
_PICK = "Carefully read the following multichoice question, solve it step by step and finally pick the option associated with the correct answer in the format of \"Answer: selected option\n\n"
_OCR = "Carefully observe the image and answer the OCR-related questions below. \n\n"


@query(with_view(FX.MCQ, f""", c AS (SELECT {_ASKED}, {_CASES} AS ds, {_KINDS} AS kind FROM fx)
    SELECT idx, CASE
      WHEN ds IN ('MMMU_x', 'MMStar') THEN 'image=i | text=' || CASE WHEN idx % 3 > 0 THEN {S.lit(_PICK)} ELSE {S.lit(_STEP)} END || {_HINT} || q || {_NL} || CASE WHEN idx % 3 > 0 THEN {_LINES1} ELSE '' END
      WHEN ds = 'plain' AND idx % 3 > 0 THEN 'image=i | text=' || {_LABELLED} || {S.lit(K.LETTER_ONLY)}
      WHEN ds = 'plain' THEN 'text=Carefully read the following question. Answer the question directly. | image=i | text=' || {_LABELLED}
      WHEN ds = 'ChartQA_x' THEN 'image=i | text=' || {S.lit(_STEP)} || q WHEN ds = 'OCRBench' THEN 'image=i | text=' || {S.lit(_OCR)} || q
      WHEN ds = 'HallusionBench' THEN 'image=i | text=' || q || ' Yes or No?'
      WHEN ds = 'MMVet' THEN 'text=Answer this question in detail. | image=i | text=' || q ELSE 'image=i | text=' || q END AS step_prompt,
      'image=i | text=' || CASE WHEN kind = 'MCQ' THEN regexp_replace({_LABELLED} || CASE WHEN idx % 3 = 0 THEN '' WHEN idx % 5 = 0 AND ds <> 'MMMU_x' THEN {S.lit(K.MCQ_SELECT["cn"])} ELSE {S.lit(K.MCQ_SELECT["en"])} END, '\\s+$', '')
        WHEN ds = 'HallusionBench' THEN q || {S.lit(K.YES_NO_SUFFIX)} WHEN kind = 'VQA' AND ds <> 'MMVet' THEN q || {S.lit(K.SHORT_WORDS_SUFFIX)} ELSE q END AS short_prompt FROM c"""))
def prompt_policies(src: Source) -> DataFrame:
    """The same rows under two prompt policies, with and without options, in two languages."""
    rows = src.spark.sql(f"SELECT {_ASKED}, {_CASES} AS ds, {_KINDS} AS kind FROM {{fx}}", fx=_mcq(src))
    images, options = F.array(F.lit("i")), {c: f"{c}1" for c in "ABCD"}

    def message(policies: tuple[P.PromptPolicy, ...]):
        return M.as_text_log(P.policy_message(policies, "ds", "kind", "q", options, images, "hint"))

    return rows.select("idx", message(P.STEP_BY_STEP_POLICIES).alias("step_prompt"), message(P.SHORT_ANSWER_POLICIES).alias("short_prompt"))


@query(with_view(FX.MCQ, """ SELECT idx, 'text=sys | image=f1 | image=f2 | text=frames of ' || category || ' | text=Question: ' || question || chr(10) || 'Answer: ' AS frames_prompt,
    'text=sys | video=' || category || '.mp4 | text=whole | text=Question: ' || question || chr(10) || 'Answer: ' AS video_prompt FROM fx"""))
def prompt_video(src: Source) -> DataFrame:
    rows = src.view(FX.MCQ)
    frames = M.video_message("sys", F.array(F.lit("f1"), F.lit("f2")), None, F.concat(F.lit("frames of "), "category"), "question")
    whole = M.video_message("sys", None, F.concat("category", F.lit(".mp4")), "whole", "question")
    return rows.select("idx", M.as_text_log(frames).alias("frames_prompt"), M.as_text_log(whole).alias("video_prompt"))


@query(with_view(FX.MCQ, """, k AS (SELECT idx, idx % 3 AS n, question, category FROM fx)
    SELECT idx, CASE n WHEN 0 THEN question || chr(10) || category WHEN 1 THEN question || chr(10) || category ELSE question || chr(10) || '<image>' || chr(10) || '<image>' || chr(10) || category END AS prompt,
      CASE n WHEN 0 THEN NULL ELSE 'a.jpg' END AS image, CASE n WHEN 0 THEN 'text,text' WHEN 1 THEN 'text,image,text' ELSE 'text,image,video,text' END AS kinds FROM k"""))
def message_flattening(src: Source) -> DataFrame:
    """Plain strings as message parts, then one prompt and one image."""
    n = F.col("idx") % 3
    first, second = F.when(n > 0, "a.jpg"), F.when(n == 2, "b.MP4")
    items = F.array_compact(F.array("question", first, second, "category"))
    rows = src.view(FX.MCQ).withColumn("message", M.as_message(items))
    two_images = F.transform("message", lambda m: M.part(F.when(m["type"] == "video", "image").otherwise(m["type"]), m["value"]))
    prompt, image = M.flat_prompt(two_images)
    return rows.select("idx", prompt.alias("prompt"), image.alias("image"), F.array_join(F.transform("message", lambda m: m["type"]), ",").alias("kinds"))


# ------------------------------------------------------------------ dialogues
@query(with_view(FX.TURNS, """, t AS (SELECT *, len(string_split(text, '<ImageHere>')) - 1 AS tags FROM fx),
    w AS (SELECT *, CAST(coalesce(sum(tags) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM t)
    SELECT conv_id, turn, CASE WHEN tags = 0 THEN 'text=' || text ELSE 'image=' || CAST(conv_id AS VARCHAR) || '-' || CAST(b AS VARCHAR) || ' | text=' || replace(text, '<ImageHere>', '') END AS content FROM w"""))
def prompt_multiturn(src: Source) -> DataFrame:
    """Turns whose image tags take the next images of their conversation."""
    turns = E.dialogue_prefix(src.view(FX.TURNS))
    tags = F.size(F.split("text", K.IMAGE_HERE)) - 1
    numbers = F.sequence(F.col("images_before"), F.col("images_before") + tags)
    mine = F.transform(numbers, lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")))
    content = M.turn_content("text", mine, F.lit(0))
    return turns.select("conv_id", "turn", M.as_text_log(content).alias("content"))


@query(with_view(FX.TURNS, """, w AS (SELECT conv_id, turn, count(*) OVER p AS a, CAST(count(*) FILTER (role = 'user') OVER p AS BIGINT) AS u, coalesce(sum(length(text)) OVER p, 0) AS c,
      coalesce(sum(len(string_split(text, '<ImageHere>')) - 1) OVER p, 0) AS i FROM fx WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, a AS turns_before, u AS user_turns_before, CAST(c AS BIGINT) AS chars_before, CAST(i AS BIGINT) AS images_before FROM w"""))
def dialog_prefix(src: Source) -> DataFrame:
    keep = ["conv_id", "turn", "turns_before", "user_turns_before", "chars_before", "images_before"]
    return E.dialogue_prefix(src.view(FX.TURNS)).select(*keep)


_BUDGET = 600


@query(f"""WITH s AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rest,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS all_turns FROM conversations),
    f AS (SELECT conv_id, any_value(all_turns) AS turns, min(CASE WHEN rest <= {_BUDGET} AND (role = 'user' OR rn = 1) THEN rn END) AS first FROM s GROUP BY conv_id)
    SELECT f.conv_id, f.turns, coalesce(f.turns - f.first + 1, 0) AS kept, CAST(coalesce(sum(s.n) FILTER (s.rn >= f.first), 0) AS BIGINT) AS chars
    FROM f JOIN s ON f.conv_id = s.conv_id GROUP BY ALL""")
def dialog_truncate(src: Source) -> DataFrame:
    """Latest turns of every dialogue that fit a character budget."""
    turns = src.table("conversations")
    kept = E.truncate_dialogues(turns, _BUDGET).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("text").cast("bigint")).alias("chars")
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return sizes.join(kept, "conv_id", "left").na.fill(0, ["kept", "chars"])


@query("""WITH s AS (SELECT p_partkey, p_size * 40 AS h, 200 + (p_partkey * 13) % 2000 AS w, length(p_name) AS n FROM part),
    t AS (SELECT *, CASE WHEN h <= 1024 AND w <= 1024 THEN h WHEN w > h THEN CAST(FLOOR(h * 1024::DOUBLE / w) AS BIGINT) ELSE 1024 END AS h2,
      CASE WHEN h <= 1024 AND w <= 1024 THEN w WHEN w > h THEN 1024 ELSE CAST(FLOOR(w * 1024::DOUBLE / h) AS BIGINT) END AS w2 FROM s),
    u AS (SELECT *, CAST(85 + 170 * ceil(h2 / 512) * ceil(w2 / 512) AS BIGINT) AS image_tokens, CAST(ceil(n / 4) AS BIGINT) AS text_tokens FROM t)
    SELECT p_partkey, image_tokens, text_tokens, coalesce(CASE WHEN least(256, 900 - image_tokens - text_tokens) > 0 THEN least(256, 900 - image_tokens - text_tokens) END, -1) AS budget,
      coalesce(CASE WHEN least(256, 900 - image_tokens - text_tokens) <= 0 THEN 'Failed to obtain answer via API.Input string longer than context window. ' END, 'ok') AS reply FROM u""")
def token_budget(src: Source) -> DataFrame:
    rows = src.table("part").select(
        "p_partkey", N.image_tokens(F.col("p_size") * 40, 200 + (F.col("p_partkey") * 13) % 2000).cast("bigint").alias("image_tokens"), N.text_tokens("p_name").alias("text_tokens")
    )
    used = F.col("image_tokens") + F.col("text_tokens")
    return rows.select(
        "p_partkey", "image_tokens", "text_tokens", F.coalesce(N.completion_budget(256, 900, used), F.lit(-1)).alias("budget"),
        F.coalesce(N.budget_reply(256, 900, used), F.lit("ok")).alias("reply"),
    )


# ------------------------------------------------------------------ batch calls
def _by_length(prompt: str, temperature: float = 0.0) -> str:
    if len(prompt) % 5 == 0 and temperature == 0.0:
        return K.FAIL_MESSAGE
    return f"{'ABCZ'[len(prompt) % 4]} at {temperature}"


@query(with_view(FX.MCQ, """, p AS (SELECT model, idx, length(question || ' ' || coalesce(prediction, '')) AS n FROM fx)
    SELECT model, idx, substr('ABCZ', CAST(n % 4 AS INT) + 1, 1) || CASE WHEN n % 5 = 0 THEN ' at 0.5' ELSE ' at 0.0' END AS reply, CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END AS tries FROM p"""))
def batch_resumable(src: Source) -> DataFrame:
    """Two chunks of calls into a result table, a restart that finds nothing to do, all replies read back."""
    rows = src.view(FX.MCQ).select("model", "idx", F.concat_ws(" ", "question", F.coalesce("prediction", F.lit(""))).alias("prompt"))
    keys = ["model", "idx"]
    store = B.ResultStore(src.spark, session.new_table_path(src.spark, "replies"), B.store_schema(rows, keys), keys)
    B.run_resumable(rows, _by_length, store, tries=2, chunks=2)
    return B.run_resumable(rows, _by_length, store, tries=2).select("model", "idx", "reply", "tries")


def _count_turns(stack: list[dict]) -> str:
    return f"reply to {len(stack)} turns"


@query("""SELECT conv_id, turn, 'reply to ' || (2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ' turns' AS reply FROM conversations WHERE role = 'user'""")
def multi_turn_generation(src: Source) -> DataFrame:
    """Each user turn answered with everything said before it."""
    return B.multi_turn(src.table("conversations"), _count_turns)


#: Arrivals of a stream in three steps of ten days; some rows come a step later than their time, and a user answers a day's question again.
_ARRIVALS = """SELECT idx AS tie, model, l2_category, answer, A, B, C, D, prediction, user_id * 100 + day(ts) AS idx, CAST(ts AS TIMESTAMP) AS ts,
  least(1 + CAST(floor((day(ts) - 1) / 10) AS INT) + CASE WHEN idx % 50 = 7 THEN 1 ELSE 0 END, 3) AS step
FROM ({mcq}) JOIN (SELECT event_id, user_id, ts FROM {{events}}) ON idx = event_id"""


@query(with_view(_ARRIVALS.format(mcq=FX.MCQ).replace("{{", "{").replace("}}", "}"), "," + S.infer("fx", S.ABCD) + """,
    m AS (SELECT step, max(epoch_us(ts)) AS top FROM fx GROUP BY step),
    w AS (SELECT s.step, (max(m.top) // 1000) * 1000 - 86400000000 AS mark FROM (SELECT unnest([1, 2, 3]) AS step) s LEFT JOIN m ON m.step < s.step GROUP BY s.step),
    taken AS (SELECT i.* FROM inferred i JOIN w USING (step) WHERE w.mark IS NULL OR epoch_us(i.ts) > w.mark),
    sc AS (SELECT *, CAST(coalesce(opt, 'Z') = answer AS INT) AS hit FROM taken QUALIFY row_number() OVER (PARTITION BY model, idx ORDER BY ts DESC, tie DESC) = 1)
    SELECT model, 'overall' AS level, 'Overall' AS key, count(*) AS n, sum(hit)::DOUBLE / count(*) AS score FROM sc GROUP BY ALL
    UNION ALL SELECT model, 'l2_category', l2_category, count(*), sum(hit)::DOUBLE / count(*) FROM sc GROUP BY ALL"""))
def stream_score(src: Source) -> DataFrame:
    """Predictions read as a stream in three arrivals, scored, corrected by later answers to the same question, and the running report.

    Rows more than a day behind what has arrived are left out, and a question can be answered again for a day.
    """
    out = session.new_table_path(src.spark, "stream")
    arrivals = src.view(_ARRIVALS.format(mcq=FX.MCQ).replace("{{", "{").replace("}}", "}"))
    levels = {"overall": None, "l2_category": "l2_category"}
    for step in (1, 2, 3):
        arrivals.where(F.col("step") == step).drop("step").write.mode("append").parquet(f"{out}/arrived")
        stream = INC.read_stream(src.spark, f"{out}/arrived", arrivals.drop("step").schema, files_per_batch=1_000_000)
        scored = SC.score_options(stream.withColumn("gt", F.col("answer")), ABCD)
        signed = INC.corrections(scored, ["model", "idx"], "ts", "tie", ["model", "l2_category", "hit"])
        INC.sum_corrections(signed, out, f"{out}/checkpoint", by=("model",), levels=levels).awaitTermination()
    return INC.running_report(src.spark, out, by=("model",))
