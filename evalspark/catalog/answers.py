"""Queries on open answers: VQA, OCR, maths, tables, documents and slides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import text as T
from evalspark.operators import expand as E
from evalspark.operators import scorers as SC
from evalspark.plans import answer_reports as R


def _vqa(src: Source) -> DataFrame:
    return src.view(FX.VQA)


_GOLDS = "CASE WHEN starts_with(answer, '[') THEN CAST(answer AS JSON)::VARCHAR[] ELSE [answer] END"
_NUMBER = "regexp_matches({x}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"


def _float(x: str) -> str:
    return f"CASE WHEN {_NUMBER.format(x=f'trim({x})')} THEN CAST(trim({x}) AS DOUBLE) END"


def _percent(x: str) -> str:
    bare = f"rtrim({x}, '%')"
    return f"CASE WHEN ends_with({x}, '%') THEN ({_float(bare)}) / 100.0 ELSE {_float(x)} END"


_CONSENSUS = f"""v0 AS (SELECT *, list_transform({_GOLDS}, lambda g: {S.normal_words(S.punctuation(S.strip("g")))}) AS gs,
      {S.strip(S.phrased("prediction"))} AS q0 FROM fx),
    v1 AS (SELECT *, {S.normal_words(S.punctuation(S.strip("q0")))} AS q FROM v0),
    v AS (SELECT *, list_sum(list_transform(gs, lambda g: least(1.0::DOUBLE,
      (len(list_filter(gs, lambda h: h = q)) - CAST(g = q AS INT)) / 3.0::DOUBLE))) / len(gs) AS hit FROM v1)"""


@query(with_view(FX.VQA, f", {_CONSENSUS} SELECT idx, round(hit, 9) AS hit FROM v"))
def vqa_consensus(src: Source) -> DataFrame:
    return SC.score_vqa(_vqa(src), "consensus").select("idx", F.round("hit", 9).alias("hit"))


@query(with_view(FX.VQA, f""", n AS (SELECT idx, {S.strip("answer")} AS t, {S.punctuation(S.strip("answer"))} AS p,
    {S.normal_words(S.punctuation(S.strip("answer")))} AS w FROM (SELECT idx, answer FROM fx
      UNION ALL SELECT 1000000 + idx, prediction || ' isn''t 3.5, 1,000 (dont)' FROM fx
      UNION ALL SELECT 2000000 + idx, category || ': two/three - "The" 7. End... v2.1' FROM fx)) SELECT idx, p, w FROM n"""))
def answer_normalisation(src: Source) -> DataFrame:
    """Punctuation and word clean-up of answers and of longer texts built from them."""
    rows = _vqa(src)
    texts = rows.select("idx", "answer").unionByName(rows.select(
        (F.col("idx") + 1000000).alias("idx"), F.concat("prediction", F.lit(" isn't 3.5, 1,000 (dont)")).alias("answer")
    )).unionByName(rows.select(
        (F.col("idx") + 2000000).alias("idx"), F.concat("category", F.lit(': two/three - "The" 7. End... v2.1')).alias("answer")
    ))
    stripped = T.strip("answer")
    return texts.select("idx", T.clean_punctuation(stripped).alias("p"), T.normalise_answer("answer").alias("w"))


def _squeeze(x: str) -> str:
    return S.join(S.words(f"lower({x})"))


_ANLS = f"""a0 AS (SELECT *, {_GOLDS} AS gs, {S.phrased("prediction")} AS q FROM fx),
    a1 AS (SELECT *, 1 - list_min(list_transform(gs, lambda g: CASE WHEN greatest(length(g), length(q)) = 0 THEN 0.0::DOUBLE ELSE
      levenshtein({_squeeze("g")}, {_squeeze("q")})::DOUBLE / greatest(length(g), length(q)) END)) AS best FROM a0),
    v AS (SELECT *, CASE WHEN best < 0.5 THEN 0.0 ELSE best END AS hit FROM a1)"""


@query(with_view(FX.VQA, f", {_ANLS} SELECT idx, hit FROM v"))
def vqa_anls(src: Source) -> DataFrame:
    return SC.score_vqa(_vqa(src), "anls").select("idx", "hit")


_RELAXED = f"""r0 AS (SELECT *, {_percent("num_prediction")} AS t, {_percent("num_answer")} AS p FROM fx),
    v AS (SELECT *, CAST(CASE WHEN p IS NOT NULL AND t IS NOT NULL AND t <> 0 THEN abs(p - t) / abs(t) <= 0.05
      ELSE lower(num_prediction) = lower(num_answer) END AS DOUBLE) AS hit FROM r0)"""


@query(with_view(FX.VQA, f", {_RELAXED} SELECT idx, hit FROM v"))
def vqa_relaxed(src: Source) -> DataFrame:
    return SC.score_vqa(_vqa(src), "relaxed", "num_answer", "num_prediction").select("idx", "hit")


@query(with_view(FX.VQA, f""", v AS (SELECT idx, list_max(list_transform({_GOLDS}, lambda g:
    CAST({S.strip("lower(g)")} = {S.strip("lower(prediction)")} AS DOUBLE))) AS hit FROM fx) SELECT idx, hit FROM v"""))
def vqa_exact(src: Source) -> DataFrame:
    return SC.score_vqa(_vqa(src), "exact").select("idx", "hit")


@query(with_view(FX.VQA, f""", {_CONSENSUS}, l AS (SELECT model, 'overall' AS level, 'Overall' AS key, hit FROM v
    UNION ALL SELECT model, 'split', split, hit FROM v)
    SELECT model, level, key, count(*) AS n, round(sum(hit) / count(*) * 100, 6) AS score FROM l GROUP BY ALL"""))
def vqa_report(src: Source) -> DataFrame:
    report = R.vqa(SC.score_vqa(_vqa(src), "consensus"), by=("model",))
    return report.withColumn("score", F.round("score", 6))


@query(with_view(FX.VQA, f""", {_ANLS}, l AS (SELECT model, 'overall' AS level, 'Overall' AS key, hit FROM v
    UNION ALL SELECT model, 'category', category, hit FROM v)
    SELECT model, level, key, count(*) AS n, round(sum(hit) / count(*) * 100, 6) AS score FROM l GROUP BY ALL"""))
def vqa_category_report(src: Source) -> DataFrame:
    report = R.vqa(SC.score_vqa(_vqa(src).drop("split"), "anls"), by=("model",))
    return report.withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ OCR and containment
def _flat(x: str) -> str:
    return f"replace({S.strip(x)}, chr(10), ' ')"


_OCR = f"""o0 AS (SELECT *, {_GOLDS} AS gs FROM fx),
    o AS (SELECT *, CAST(CASE WHEN ocr_category = {S.lit(K.OCR_FORMULA)}
      THEN len(list_filter(gs, lambda g: contains(replace({_flat("prediction")}, ' ', ''), replace({_flat("g")}, ' ', '')))) > 0
      ELSE len(list_filter(gs, lambda g: contains({_flat("lower(prediction)")}, {_flat("lower(g)")}))) > 0 END AS INT) AS hit FROM o0)"""
_OCR_GROUPS = {"Text Recognition": K.OCR_TEXT_RECOGNITION, **{c: [c] for c in K.OCR_OTHER}}
_OCR_ROWS = " UNION ALL ".join(
    f"SELECT model, {S.lit(k)} AS key, coalesce(sum(hit) FILTER (ocr_category IN ({', '.join(S.lit(x) for x in v)})), 0)::DOUBLE AS score "
    "FROM o GROUP BY model" for k, v in _OCR_GROUPS.items()
)


@query(with_view(FX.VQA, f""", {_OCR}, c AS ({_OCR_ROWS}) SELECT model, key, score FROM c
    UNION ALL SELECT model, 'Final Score', sum(score) FROM c GROUP BY model
    UNION ALL SELECT model, 'Final Score Norm', sum(score) / 10 FROM c GROUP BY model"""))
def ocr_scorecard(src: Source) -> DataFrame:
    rows = _vqa(src).withColumn("category", F.col("ocr_category"))
    listed = rows.withColumn("answer", F.to_json(T.to_list("answer")))
    return R.ocr_card(SC.score_ocr(listed), by=("model",))



@query(with_view(FX.VQA, """, c AS (SELECT *, CAST(contains(replace(lower(trim(prediction)), '.', ''), replace(lower(trim(model)), '.', '')) AS INT)
      AS hit FROM fx),
    l AS (SELECT 'average' AS level, 'Average' AS key, hit FROM c UNION ALL SELECT 'category', category, hit FROM c)
    SELECT level, key, count(*) AS n, sum(hit)::DOUBLE / count(*) * 100 AS score FROM l GROUP BY ALL"""))
def containment_report(src: Source) -> DataFrame:
    rows = SC.score_containment(_vqa(src).withColumn("answer", F.col("model")))
    return R.containment(rows, by=())


# ------------------------------------------------------------------ maths
_MATHS_INFER = S.infer("fx", {"A": "'red'", "B": "'green'", "C": "'blue'"}, pred="res")
_INT = "CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+$') THEN CAST(trim({x}) AS BIGINT) END"
_MATHS = f"""{_MATHS_INFER}, m AS (SELECT *, CAST(coalesce(CASE WHEN question_type = 'multi_choice' THEN opt = answer_option
      WHEN answer_type = 'integer' THEN {_INT.format(x="res")} = {_INT.format(x="answer")}
      WHEN answer_type = 'float' THEN {_float("res")} = {_float("answer")} ELSE answer = 'None' END, false) AS INT) AS hit FROM inferred)"""


@query(with_view(FX.TYPED, f""", {_MATHS}, e AS (SELECT model, idx, log, hit, unnest(['Overall', 'algebra', 'sk' || substr(skills, 16, 1), task]) AS key,
      unnest([0, 1, 2, 3]) AS place FROM m)
    SELECT model, key, count(*) AS tot, count(*) FILTER (log = 'Prefetch succeed') AS prefetch, CAST(sum(hit) AS BIGINT) AS hit,
      (count(*) FILTER (log = 'Prefetch succeed'))::DOUBLE / count(*) * 100 AS prefetch_rate, sum(hit)::DOUBLE / count(*) * 100 AS acc,
      min(idx) AS first_pos, arg_min(place, idx * 10 + place) AS first_place FROM e GROUP BY ALL"""))
def math_task_skill_report(src: Source) -> DataFrame:
    return R.task_skill(SC.score_maths(src.view(FX.TYPED)), by=("model",), pos="idx")


@query(with_view(FX.TYPED, f""", {_MATHS}, x AS (SELECT *, CAST(lower(trim(res)) = lower(trim(answer))
      OR coalesce(abs({_float("res")} - {_float("answer")}) < 1e-6, false) AS INT) AS h2 FROM m),
    l AS (SELECT model, 'Overall' AS key, log, h2 FROM x UNION ALL SELECT model, category, log, h2 FROM x)
    SELECT model, key, count(*) AS tot, count(*) FILTER (log = 'Prefetch succeed') AS prefetch, CAST(sum(h2) AS BIGINT) AS hit,
      (count(*) FILTER (log = 'Prefetch succeed'))::DOUBLE / count(*) * 100 AS prefetch_rate, sum(h2)::DOUBLE / count(*) * 100 AS acc
    FROM l GROUP BY ALL"""))
def math_subject_report(src: Source) -> DataFrame:
    """Free answers compared as text or as value (no choices)."""
    rows = src.view(FX.TYPED).withColumn("choices", F.lit("[]"))
    return R.subject(SC.score_maths_expression(rows), by=("model",))


@query(with_view(FX.TYPED, f""", {S.infer("fx", {"A": "'red'", "B": "'green'", "C": "'blue'"}, pred="res")}
    SELECT idx, CASE WHEN question_type = 'multi_choice' THEN opt
      WHEN answer_type = 'integer' AND {_INT.format(x="res")} = {_INT.format(x="answer")} AND {_INT.format(x="res")} <> 0
        THEN CAST({_INT.format(x="res")} AS VARCHAR)
      WHEN answer_type = 'float' AND {_float("res")} = {_float("answer")} AND {_float("res")} <> 0 THEN res END AS prefetched FROM inferred"""))
def math_prefetch(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED).withColumn("prediction", F.col("res"))
    return SC.prefetch_maths(rows).select("idx", "prefetched")


# ------------------------------------------------------------------ tables
_TRUTH = """CASE WHEN contains(lower(prediction), 'true') AND contains(lower(prediction), 'false') THEN NULL
      WHEN contains(lower(prediction), 'true') AND table_answer = '1' THEN 1 WHEN contains(lower(prediction), 'false') AND table_answer = '0' THEN 1
      ELSE 0 END"""


@query(with_view(FX.TYPED, f" SELECT idx, coalesce({_TRUTH}, -1) AS score FROM fx"))
def table_truefalse(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED).withColumn("answer", F.col("table_answer"))
    return SC.score_table_truth(rows).select("idx", F.coalesce("score", F.lit(-1)).alias("score"))


def _table_rows(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED)
    return rows.withColumns({
        "answer": F.col("table_answer"), "prediction": F.regexp_replace("prediction", "^Answer: ", ""),
    })




@query(with_view(FX.TYPED, """, f AS (SELECT idx, table_answer AS g, CASE prediction WHEN '$1,200 million' THEN 1.2e9 WHEN '12 %' THEN 12e-2 END AS a,
      CASE prediction WHEN '$1,200 million' THEN 1200.0 WHEN '12 %' THEN 12.0 END AS b FROM fx)
    SELECT idx, CAST(coalesce(a = CAST(g AS DOUBLE), false) AS INT) AS exact_score,
      CAST(coalesce(a = CAST(g AS DOUBLE) OR b = CAST(g AS DOUBLE), false) AS INT) AS score FROM f"""))
def table_financial(src: Source) -> DataFrame:
    return SC.score_table_financial(_table_rows(src)).select("idx", "exact_score", "score")


@query(with_view(FX.TYPED, """, d AS (SELECT idx, CASE o WHEN 0 THEN p || '||' || lower(p) WHEN 1 THEN res || '||' || answer ELSE p END AS pred,
      CASE o WHEN 0 THEN upper(p) WHEN 1 THEN answer || '.00' ELSE p || ' (note)[3]' END AS gold
      FROM (SELECT *, idx % 3 AS o, task || '-' || category AS p FROM fx)),
    e AS (SELECT idx, CAST(CASE WHEN idx % 3 = 1 THEN
        CASE WHEN regexp_matches(split_part(pred, '||', 1), '^[0-9]') THEN 1 ELSE 0 END ELSE 1 END AS INT) AS score FROM d)
    SELECT idx, score FROM e"""))
def table_denotation(src: Source) -> DataFrame:
    """Repeated, re-cased, annotated and numerically equal values against one gold value."""
    rows = src.view(FX.TYPED)
    p, kind = F.concat_ws("-", "task", "category"), F.col("idx") % 3
    built = rows.select(
        "idx",
        F.when(kind == 0, F.concat(p, F.lit("||"), F.lower(p))).when(kind == 1, F.concat("res", F.lit("||"), "answer")).otherwise(p).alias("prediction"),
        F.when(kind == 0, F.upper(p)).when(kind == 1, F.concat("answer", F.lit(".00"))).otherwise(F.concat(p, F.lit(" (note)[3]"))).alias("answer"),
    )
    return SC.score_table_denotation(built).select("idx", "score")


@query(with_view(FX.TYPED, f""", t AS (SELECT split, {_TRUTH} AS s FROM fx WHERE split = 'vtabfact'),
    f AS (SELECT CAST(coalesce(a = g, false) AS INT) AS e, CAST(coalesce(a = g OR b = g, false) AS INT) AS r FROM (SELECT CAST(table_answer AS DOUBLE) AS g,
      CASE prediction WHEN '$1,200 million' THEN 1.2e9 WHEN '12 %' THEN 12e-2 END AS a,
      CASE prediction WHEN '$1,200 million' THEN 1200.0 WHEN '12 %' THEN 12.0 END AS b FROM fx WHERE split = 'fintabnetqa'))
    SELECT split, count(*) AS n, round((coalesce(sum(s), 0) + 1e-9) / (count(*) + 1e-9), 8) * 100 AS score,
      round((coalesce(sum(s), 0) + 1e-9) / (count(*) + 1e-9), 8) * 100 AS exact_score, count(*) - count(s) AS unparsed FROM t GROUP BY split
    UNION ALL SELECT 'fintabnetqa', count(*), round((sum(r) + 1e-9) / (count(*) + 1e-9), 8) * 100,
      round((sum(e) + 1e-9) / (count(*) + 1e-9), 8) * 100, 0 FROM f
    UNION ALL SELECT split, count(*), round((count(*) FILTER (regexp_replace(prediction, '^Answer: ', '') = table_answer) + 1e-9) / (count(*) + 1e-9), 8) * 100,
      round((count(*) FILTER (regexp_replace(prediction, '^Answer: ', '') = table_answer) + 1e-9) / (count(*) + 1e-9), 8) * 100, 0
      FROM fx WHERE split IN ('vwtq', 'vwtq_syn') GROUP BY split"""))
def table_report(src: Source) -> DataFrame:
    """All four table splits, each by its own scorer."""
    rows = _table_rows(src)
    none = F.lit(None).cast("int").alias("exact_score")
    truth = SC.score_table_truth(rows.where("split = 'vtabfact'")).select("split", "score", none)
    money = SC.score_table_financial(rows.where("split = 'fintabnetqa'")).select("split", "score", "exact_score")
    lists = SC.score_table_denotation(rows.where("split in ('vwtq', 'vwtq_syn')")).select("split", "score", none)
    return R.tables(truth.unionByName(money).unionByName(lists), by=())


# ------------------------------------------------------------------ documents and slides


def _similar(a: str, b: str) -> str:
    return (
        f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE "
        f"WHEN 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) <= 0.5 THEN 0.0::DOUBLE "
        f"ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"
    )


_FLOAT_MATCH = " OR ".join(
    f"abs({g} - p) <= 0.01 * greatest(abs({g}), abs(p)) OR round(p * 100) = round({g} * 100)" for g in ("g / 100", "g", "g * 100")
)
_DOC = f"""d0 AS (SELECT *, {_float("answer")} AS g, {_float("res")} AS p FROM fx),
    d AS (SELECT *, coalesce(CASE answer_format WHEN 'Int' THEN CAST({_INT.format(x="answer")} = trunc(p) AS DOUBLE)
      WHEN 'Float' THEN CAST(p IS NOT NULL AND ({_FLOAT_MATCH}) AS DOUBLE)
      WHEN 'Str' THEN CASE WHEN regexp_matches(answer, '^[0-9]+([-\\s][0-9]+)?$') THEN CAST(answer = res AS DOUBLE) ELSE {_similar("answer", "res")} END
      ELSE CAST(answer = res AS DOUBLE) END, 0.0) AS score FROM d0)"""


def _documents(src: Source) -> DataFrame:
    return SC.score_document(src.view(FX.TYPED).withColumn("pred", F.col("res")))


@query(with_view(FX.TYPED, f", {_DOC} SELECT idx, score FROM d"))
def doc_type_score(src: Source) -> DataFrame:
    return _documents(src).select("idx", "score")


_DOC_CATEGORIES = {
    "overall_acc": "true", "text": "contains(evidence_sources, 'Pure-text')", "layout": "contains(evidence_sources, 'Layout')",
    "table": "contains(evidence_sources, '\"Table\"')", "chart": "contains(evidence_sources, '\"Chart\"')",
    "image": "contains(evidence_sources, '\"Figure\"')", "single-page": "evidence_pages = '[3]'", "multi-page": "evidence_pages = '[1, 2]'",
    "unanswerable": "evidence_pages = '[]'",
}
_DOC_ROWS = " UNION ALL ".join(
    f"SELECT model, '{k}' AS category, count(*) FILTER ({c}) AS num, round(coalesce(sum(score) FILTER ({c}) / nullif(count(*) FILTER ({c}), 0), 0.0), 9)"
    " AS avg_score FROM d GROUP BY model" for k, c in _DOC_CATEGORIES.items()
)


@query(with_view(FX.TYPED, f""", {_DOC} {_DOC_ROWS}
    UNION ALL SELECT model, 'overall_f1', count(*), round(sum(score) / count(*), 9) FROM d GROUP BY model"""))
def doc_report(src: Source) -> DataFrame:
    report = R.documents(_documents(src), by=("model",))
    return report.withColumn("avg_score", F.round("avg_score", 9))


@query(with_view(FX.TYPED, f""", a AS (SELECT model, {_similar("lower(task)", "lower(task || category)")} AS s1, {_similar("lower(answer)", "lower(res)")} AS s2 FROM fx)
    SELECT model, 'anls' AS category, count(*) AS num, round(avg(s1), 9) AS avg FROM a GROUP BY model"""))
def doc_anls(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED).withColumns({"answer": F.col("task"), "pred": F.concat("task", "category")})
    return R.document_anls(SC.score_document_anls(rows), by=("model",)).withColumn("avg", F.round("avg", 9))


_SLIDE = f"""s0 AS (SELECT idx, model, lower(task || ' ' || category) AS g, lower(task || ' ' || task || ' ' || answer || ' ' || category) AS p FROM fx),
    s1 AS (SELECT *, {S.words("g")} AS gw, {S.words("p")} AS pw FROM s0),
    s2 AS (SELECT *, len(list_filter(pw, lambda w: list_contains(gw, w)))::DOUBLE AS c FROM s1),
    s AS (SELECT idx, model, {_similar("g", "p")} AS anls, CAST(trim(g) = trim(p) AS INT) AS em,
      CASE WHEN c / len(gw) + c / len(pw) > 1e-4 THEN 2 * (c / len(gw)) * (c / len(pw)) / (c / len(gw) + c / len(pw)) ELSE 0.0 END AS f1 FROM s2)"""


@query(with_view(FX.TYPED, f", {_SLIDE} SELECT idx, anls, em, round(f1, 9) AS f1 FROM s"))
def slide_triple(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED).withColumns({
        "answer": F.concat_ws(" ", "task", "category"), "pred": F.concat_ws(" ", "task", "task", "answer", "category"),
    })
    return SC.score_slides(rows).select("idx", "anls", "em", F.round("f1", 9).alias("f1"))


@query(with_view(FX.TYPED, f""", {_SLIDE} SELECT model, 'anls' AS category, count(*) AS num, round(avg(anls), 9) AS avg FROM s GROUP BY model
    UNION ALL SELECT model, 'EM', count(*), round(avg(em), 9) FROM s GROUP BY model
    UNION ALL SELECT model, 'F1', count(*), round(avg(f1), 9) FROM s GROUP BY model"""))
def slide_report(src: Source) -> DataFrame:
    rows = src.view(FX.TYPED).withColumns({
        "answer": F.concat_ws(" ", "task", "category"), "pred": F.concat_ws(" ", "task", "task", "answer", "category"),
    })
    return R.slides(SC.score_slides(rows), by=("model",)).withColumn("avg", F.round("avg", 9))


@query("""
    WITH p AS (SELECT doc_id, string_split_regex(text, '[.]\\s') AS pages FROM documents),
    e AS (SELECT doc_id, len(pages) AS n, unnest(pages) AS page, unnest(range(len(pages))) AS page_no FROM p)
    SELECT doc_id, CAST(page_no AS INT) AS page_no, md5(page) AS digest,
      CAST(FLOOR(page_no / greatest(ceil(n / greatest(ceil(n / 20), 1)), 1)) AS INT) AS page_group FROM e""")
def document_pages(src: Source) -> DataFrame:
    """All page rows of a document and their page groups."""
    docs = src.table("documents").select("doc_id", F.split("text", "[.]\\s").alias("image_path"))
    pages = E.document_pages(docs)
    return pages.select("doc_id", "page_no", F.md5(F.col("page").cast("binary")).alias("digest"), "page_group")
