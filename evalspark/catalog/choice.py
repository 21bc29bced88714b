"""Multiple-choice, circular and yes/no queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.catalog import fixtures as FX
from evalspark.catalog import sqltext as S
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import answers as A
from evalspark.functions import text as T
from evalspark.operators import circular as C
from evalspark.operators import keys as OK
from evalspark.operators import scorers as SC
from evalspark.plans import choice_reports as R
from evalspark.sources import preparation as PR

ABCD = {c: c for c in "ABCD"}
_SCORED = S.infer("fx", S.ABCD) + ", sc AS (SELECT *, CAST(coalesce(opt, 'Z') = answer AS INT) AS hit FROM inferred)"


def _mcq(src: Source) -> DataFrame:
    return src.view(FX.MCQ)


def _scored(src: Source) -> DataFrame:
    rows = _mcq(src)
    answers = rows.select("idx", "answer", F.col("idx").alias("pos"))
    return SC.score_mcq(rows.drop("answer"), answers, ABCD, keys=("idx",), pos="pos")


@query(with_view(FX.MCQ, "," + _SCORED + " " + S.means(
    "sc", "model, split", {"overall": None, "l2_category": "l2_category", "category": "category"}, "hit")))
def mcq_accuracy_report(src: Source) -> DataFrame:
    """Accuracy of every model on every split and ability."""
    return R.accuracy(_scored(src), by=("model",))


@query(with_view(FX.MCQ, "," + _SCORED + f"""
    SELECT idx, coalesce(opt, 'none') AS opt, hit,
           'Match Log: ' || CASE WHEN opt IS NULL THEN {S.lit(K.NO_JUDGE_LOG)} ELSE p0 END || '. ' AS log FROM sc"""))
def mcq_row_scores(src: Source) -> DataFrame:
    return _scored(src).select("idx", F.coalesce("opt", F.lit("none")).alias("opt"), "hit", "log")


@query(with_view(FX.MCQ, """
    SELECT idx, coalesce(regexp_extract_all(p, 'Answer:\\s*([A-Da-d])([^A-Za-z]|$)', 1)[-1], p) AS tag_d,
      coalesce(regexp_extract_all(p, 'Answer:\\s*([A-Ia-i])([^A-Za-z]|$)', 1)[-1], p) AS tag_i,
      coalesce(regexp_extract_all(p, 'Answer:\\s*([A-La-l])([^A-Za-z]|$)', 1)[-1], p) AS tag_l
    FROM (SELECT idx, coalesce(prediction, 'nan') AS p FROM fx)"""))
def mcq_tag_extraction(src: Source) -> DataFrame:
    p = T.as_text("prediction")
    return _mcq(src).select("idx", *[A.last_option_tag(p, x).alias(f"tag_{x.lower()}") for x in "DIL"])


@query(with_view(FX.MCQ, """
    SELECT idx, coalesce(regexp_extract_all(p, '(答案|Answer|answer)(：|:)\\s*([a-dA-D])([^A-Za-z]|$)', 3)[-1], p) AS tag
    FROM (SELECT idx, CASE WHEN idx % 2 = 0 THEN replace(coalesce(prediction, 'nan'), 'Answer: ', '答案：')
                           ELSE coalesce(prediction, 'nan') END AS p FROM fx)"""))
def mcq_bilingual_tag(src: Source) -> DataFrame:
    p = T.as_text("prediction")
    p = F.when(F.col("idx") % 2 == 0, F.replace(p, F.lit("Answer: "), F.lit("答案："))).otherwise(p)
    return _mcq(src).select("idx", p.alias("p")).select("idx", A.last_bilingual_tag("p").alias("tag"))


_OPEN = "SELECT idx, model, CASE WHEN idx % 5 = 0 THEN NULL ELSE A END AS A, B, C, D, " \
        "CASE WHEN idx % 5 = 0 THEN l2_category ELSE answer END AS answer, prediction FROM fx"


@query(with_view(FX.MCQ, f""", o AS ({_OPEN}),
    r AS (SELECT idx, model, CASE WHEN A IS NULL THEN answer ELSE A END AS A, CASE WHEN A IS NULL THEN 'Other Answers' ELSE B END AS B,
          C, D, CASE WHEN regexp_matches(answer, '^[A-Z]$') THEN answer ELSE 'A' END AS gt, prediction FROM o),
    {S.infer("r", S.ABCD)} SELECT idx, A, B, coalesce(opt, 'none') AS opt, CAST(coalesce(opt, 'Z') = gt AS INT) AS hit FROM inferred"""))
def mcq_open_questions(src: Source) -> DataFrame:
    """Open questions scored as two-option ones."""
    opened = _mcq(src).withColumns({
        "A": F.when(F.col("idx") % 5 != 0, F.col("A")),
        "answer": F.when(F.col("idx") % 5 == 0, F.col("l2_category")).otherwise(F.col("answer")),
    })
    rows = SC.open_questions_as_options(opened).withColumn("gt", SC.gold_letter("answer"))
    return SC.score_options(rows, ABCD).select("idx", "A", "B", F.coalesce("opt", F.lit("none")).alias("opt"), "hit")


@query(with_view(FX.MCQ, "," + _SCORED + """,
    b AS (SELECT model, split, l2_category, category, hit FROM sc UNION ALL SELECT model, 'ALL', l2_category, category, hit FROM sc),
    c AS (SELECT model, split, category, count(*) AS n, sum(hit)::DOUBLE / count(*) AS score FROM b GROUP BY ALL),
    p AS (SELECT DISTINCT model, l2_category, category FROM sc)
    SELECT model, split, 'overall' AS level, 'Overall' AS key, count(*) AS n, round(sum(hit)::DOUBLE / count(*), 9) AS score FROM b GROUP BY ALL
    UNION ALL SELECT model, split, 'category', category, n, round(score, 9) FROM c
    UNION ALL SELECT p.model, c.split, 'l2_category', p.l2_category, CAST(sum(c.n) AS BIGINT), round(sum(c.score) / count(*), 9)
      FROM p JOIN c ON p.model = c.model AND p.category = c.category GROUP BY ALL"""))
def mcq_macro_report(src: Source) -> DataFrame:
    report = R.macro_accuracy(_scored(src), by=("model",))
    return report.withColumn("score", F.round("score", 9))


@query(with_view(FX.MCQ, "," + _SCORED + """,
    r AS (SELECT model, cycle_category AS cycle, category AS type, sum(hit)::DOUBLE / count(*) AS score FROM sc GROUP BY ALL
          UNION ALL SELECT model, cycle_category, 'all', sum(hit)::DOUBLE / count(*) FROM sc GROUP BY ALL)
    SELECT model, cycle, type, round(score, 9) AS score FROM r
    UNION ALL SELECT r.model, 'Average', r.type, round(sum(r.score) / max(c.n), 9)
      FROM r JOIN (SELECT model, count(*) AS n FROM r WHERE type = 'all' GROUP BY 1) c ON r.model = c.model GROUP BY ALL"""))
def mcq_cycle_report(src: Source) -> DataFrame:
    report = R.cycle_accuracy(_scored(src), by=("model",))
    return report.withColumn("score", F.round("score", 9))


@query(with_view(FX.MCQ, "," + _SCORED + " " + S.means(
    "sc", "model, split", {"overall": None, "l2_category": "l2_category", "cycle_category": "cycle_category"}, "hit")))
def mcq_group_report(src: Source) -> DataFrame:
    return R.accuracy_by(_scored(src), ["l2_category", "cycle_category"], by=("model",))


_LETTER_AE = "t0 AS (SELECT *, " + "".join("replace(" for _ in K.LEAD_INS_AE) + S.strip("coalesce(prediction, '')") + "".join(
    f", {S.lit(s)}, '')" for s in K.LEAD_INS_AE) + " AS rest FROM fx)," + f"""
    t1 AS (SELECT *, CASE WHEN prediction IS NULL THEN '' WHEN regexp_matches(rest, '[ABCDE]') THEN regexp_extract(rest, '[ABCDE]')
      WHEN len({S.words("rest")}) > 10 THEN ''
      WHEN contains('(a)', lower(rest)) THEN 'A' WHEN contains('(b)', lower(rest)) THEN 'B' WHEN contains('(c)', lower(rest)) THEN 'C'
      WHEN contains('(d)', lower(rest)) THEN 'D' WHEN contains('(e)', lower(rest)) THEN 'E' ELSE '' END AS extracted FROM t0),
    t2 AS (SELECT *, CAST(extracted = answer AS INT) AS score FROM t1)"""


@query(with_view(FX.MCQ, "," + _LETTER_AE + " SELECT idx, extracted, score, extracted = '' AS rejected FROM t2"))
def real_world_choice(src: Source) -> DataFrame:
    return SC.score_real_world(_mcq(src)).select("idx", "extracted", "score", "rejected")


_NESTED_TASKS = " UNION ALL ".join(f"SELECT '{t}' AS task, '{s}' AS subtask" for t in K.NESTED_TASKS for s in K.NESTED_SUBTASKS)


@query(with_view(FX.MCQ, "," + _LETTER_AE + f""",
    f AS (SELECT model, string_split(task_path, '/')[1] AS task, string_split(task_path, '/')[2] AS subtask,
            CASE WHEN contains(lower(sub_path), 'attribute') THEN string_split(lower(sub_path), '/')[1] || '/attribute'
                 ELSE lower(sub_path) END AS path, score FROM t2),
    d AS (SELECT DISTINCT model FROM f), g AS (SELECT * FROM d, ({_NESTED_TASKS})),
    st AS (SELECT model, task, subtask, count(*) AS n, sum(score)::DOUBLE / count(*) AS score FROM f GROUP BY ALL),
    tk AS (SELECT model, task, count(*) AS n, sum(score)::DOUBLE / count(*) AS score FROM f GROUP BY ALL)
    SELECT model, 'category' AS level, task, subtask, path, count(*) AS n, sum(score)::DOUBLE / count(*) AS score FROM f GROUP BY ALL
    UNION ALL SELECT g.model, 'subtask', g.task, g.subtask, NULL, coalesce(st.n, 0), coalesce(st.score, 0.0)
      FROM g LEFT JOIN st ON g.model = st.model AND g.task = st.task AND g.subtask = st.subtask
    UNION ALL SELECT model, 'task', task, NULL, NULL, n, score FROM tk
    UNION ALL SELECT model, 'overall', NULL, NULL, NULL, count(*), sum(score)::DOUBLE / count(*) FROM f GROUP BY model"""))
def nested_dimension_report(src: Source) -> DataFrame:
    rows = SC.score_real_world(_mcq(src).withColumns({"category": F.col("task_path"), "l2_category": F.col("sub_path")}))
    return R.nested_accuracy(rows, by=("model",))


# ------------------------------------------------------------------ circular
#: Step between the rotations of a question in the fixture, whose indices pass a million.
_OFFSET = 1_000_000_000_000
_TOKENS = {c: f"string_split(replace({c}, ',', ' '), ' ')" for c in "CD"}
_LOWER = {c: f"string_split(replace(lower({c}), ',', ' '), ' ')" for c in "CD"}


def _ok(c: str, letters: str) -> str:
    names = " AND ".join(f"list_contains({_TOKENS[c]}, '{x}')" for x in letters)
    return f"NOT (({names}) OR list_contains({_LOWER[c]}, 'all') OR list_contains({_LOWER[c]}, 'none'))"


def _moved(i: int, n: int, r: int) -> str:
    return "ABCD"[(i - r) % n] if i < n else "ABCD"[i]


_EXPANDED = " UNION ALL ".join(
    f"SELECT idx + {r} * 1000000 AS idx, question, " + ", ".join(f"{_moved(i, n, r)} AS {'ABCD'[i]}" for i in range(4))
    + ", CASE answer " + " ".join(f"WHEN '{'ABCD'[i]}' THEN '{'ABCD'[(i + r) % n]}'" for i in range(n)) + " ELSE answer END AS answer, "
    + ("image" if r == 0 else "CAST(idx AS VARCHAR)") + f" AS image FROM k WHERE n = {n}"
    for n in (2, 3, 4) for r in range(n)
)


@query(with_view(FX.EXPAND, f""", k AS (SELECT *, CASE WHEN D IS NOT NULL AND {_ok("D", "ABC")} THEN 4
    WHEN C IS NOT NULL AND {_ok("C", "AB")} THEN 3 ELSE 2 END AS n FROM fx) {_EXPANDED}"""))
def circular_expand(src: Source) -> DataFrame:
    """Every rotation of every question."""
    return C.expand_rotations(src.view(FX.EXPAND), index="idx")


@query(with_view(FX.CIRCULAR, "," + S.infer("fx", S.ABCD) + """,
    g AS (SELECT *, idx % 1000000000000 AS gid, CAST(FLOOR(idx / 1000000000000) AS BIGINT) AS rolling,
          opt IS NOT NULL AND opt <> answer AS wrong FROM inferred),
    f AS (SELECT model, gid, count(*) AS n, count(*) FILTER (opt IS NULL) AS n_open, min(CASE WHEN wrong THEN rolling END) AS fw FROM g GROUP BY ALL)
    SELECT f.model, f.gid AS idx, CAST(fw IS NULL AND n_open = 0 AS INT) AS hit, f.n, f.n_open,
      CASE WHEN fw IS NOT NULL THEN 'Failed in Prefetching Rolling ' || fw || ': Answer is ' || g.answer || ', Prediction is ' || g.prediction
             || ', Pre-fetched is ' || g.opt || '. '
           WHEN n_open = 0 THEN 'Succeed During Pre-fetching' ELSE """ + S.lit(K.NO_JUDGE_LOG) + """ END AS log
    FROM f LEFT JOIN g ON f.model = g.model AND f.gid = g.gid AND f.fw = g.rolling"""))
def circular_score(src: Source) -> DataFrame:
    rows = src.view(FX.CIRCULAR)
    scored = OK.attach_answers(rows.drop("answer"), rows, ["idx"])
    return C.score_circular(scored, ABCD, by=("model",), index="idx", offset=_OFFSET)


@query(with_view(FX.CIRCULAR, "," + S.infer("fx", S.ABCD) + """,
    g AS (SELECT *, idx % 1000000000000 AS gid, opt IS NOT NULL AND opt <> answer AS wrong FROM inferred),
    f AS (SELECT model, category, gid, bool_or(wrong) AS w, count(*) FILTER (opt IS NULL) AS n_open FROM g GROUP BY ALL),
    h AS (SELECT model, category, CAST(NOT w AND n_open = 0 AS INT) AS hit FROM f)
    SELECT model, 'none' AS split, 'overall' AS level, 'Overall' AS key, count(*) AS n, sum(hit)::DOUBLE / count(*) AS score FROM h GROUP BY ALL
    UNION ALL SELECT model, 'none', 'category', category, count(*), sum(hit)::DOUBLE / count(*) FROM h GROUP BY ALL"""))
def circular_accuracy_report(src: Source) -> DataFrame:
    rows = src.view(FX.CIRCULAR)
    scored = OK.attach_answers(rows.drop("answer"), rows, ["idx"])
    groups = C.score_circular(scored, ABCD, by=("model", "category"), index="idx", offset=_OFFSET)
    return R.accuracy(groups, by=("model",), l2=None)


@query(with_view(FX.CIRCULAR, """,
    e AS (SELECT model, idx, idx % 1000000000000 AS gid, coalesce(nullif(regexp_extract(prediction, 'Answer: ([A-D])', 1), ''), prediction) AS p FROM fx),
    l AS (SELECT *, lag(p) OVER (PARTITION BY model, gid ORDER BY idx) AS q FROM e),
    v AS (SELECT model, gid, coalesce(bool_and(regexp_matches(p, '^[A-Z]$') AND regexp_matches(q, '^[A-Z]$')) FILTER (q IS NOT NULL), true) AS ok,
      coalesce(bool_and((ascii(p) - ascii(q) + 4) % 4 = 1) FILTER (regexp_matches(p, '^[A-Z]$') AND regexp_matches(q, '^[A-Z]$')), true) AS good
      FROM l GROUP BY ALL)
    SELECT model, count(*) FILTER (ok) AS n, avg(CAST(good AS INT)) FILTER (ok) AS score FROM v GROUP BY ALL"""))
def circular_consistency(src: Source) -> DataFrame:
    flags = C.rotation_flags(src.view(FX.CIRCULAR), by=("model",), index="idx", extract=lambda c: A.last_option_tag(c), offset=_OFFSET)
    return R.consistency(flags, by=("model",))


# ------------------------------------------------------------------ yes / no
_TAGGED = f"CASE WHEN contains(prediction, 'Answer:') THEN {S.strip('''regexp_extract(prediction, '(?s)Answer:(.*)', 1)''')} ELSE prediction END"
_YES_NO = f"""y0 AS (SELECT *, lower({_TAGGED}) AS q FROM fx), y1 AS (SELECT *, {S.words(S.punctuation("q"))} AS w FROM y0),
    y2 AS (SELECT *, CASE WHEN list_contains(w, 'yes') AND NOT list_contains(w, 'no') THEN 'Yes'
      WHEN list_contains(w, 'no') AND NOT list_contains(w, 'yes') THEN 'No' ELSE 'Unknown' END AS extracted FROM y1),
    y AS (SELECT *, CAST(answer = extracted AS INT) AS score FROM y2)"""


def _yes_no(src: Source) -> DataFrame:
    return SC.score_yes_no(src.view(FX.YES_NO))


@query(with_view(FX.YES_NO, f", {_YES_NO} SELECT idx, extracted, score FROM y"))
def yesno_extract(src: Source) -> DataFrame:
    return _yes_no(src).select("idx", "extracted", "score")


@query(with_view(FX.YES_NO, f", {_YES_NO} " + S.means(
    "y", "model", {"overall": None, "category": "category", "l2_category": "l2_category"}, "score", "100.0")))
def yesno_default_report(src: Source) -> DataFrame:
    return R.yes_no_accuracy(_yes_no(src), by=("model",))


@query(with_view(FX.YES_NO, f""", {_YES_NO}, e AS (SELECT model, unnest(string_split(category, ',')) AS key, answer, extracted, score FROM y),
    l AS (SELECT model, 'category' AS level, * EXCLUDE (model) FROM e UNION ALL SELECT model, 'overall', 'Overall', answer, extracted, score FROM e),
    c AS (SELECT model, level, key, count(*) AS n, CAST(sum(score) AS BIGINT) AS r,
      (count(*) FILTER (answer = 'Yes' AND extracted = 'Yes'))::DOUBLE AS tp, (count(*) FILTER (answer <> 'Yes' AND extracted = 'Yes'))::DOUBLE AS fp,
      (count(*) FILTER (answer = 'Yes' AND extracted <> 'Yes'))::DOUBLE AS fn FROM l GROUP BY ALL),
    m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS q FROM c)
    SELECT model, level, key, n, CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * (p * q) / (p + q) END * 100 AS f1, r / n * 100 AS acc,
      p * 100 AS precision, q * 100 AS recall FROM m"""))
def yesno_f1_report(src: Source) -> DataFrame:
    return R.f1_scores(_yes_no(src), by=("model",))


@query(with_view(FX.PAIRS, """,
    r AS (SELECT *, row_number() OVER (PARTITION BY category, image_path ORDER BY idx) AS rn FROM fx),
    p AS (SELECT category, image_path, max(CASE WHEN rn = 1 THEN score END) AS s1, max(CASE WHEN rn = 2 THEN score END) AS s2 FROM r GROUP BY ALL),
    b AS (SELECT category, avg(s1 * s2) AS both, count(*) FILTER (s2 IS NULL) AS n_unpaired FROM p GROUP BY ALL),
    s AS (SELECT category, count(*) AS n, avg(score) AS single FROM fx GROUP BY ALL),
    c AS (SELECT s.category, s.n, b.n_unpaired, s.single * 100 + coalesce(b.both, 0.0) * 100 AS score FROM s JOIN b ON s.category = b.category)
    SELECT 'category' AS level, category AS key, n, n_unpaired, round(score, 6) AS score FROM c
    UNION ALL SELECT 'super', CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'rush' ELSE 'calm' END,
      CAST(sum(n) AS BIGINT), CAST(sum(n_unpaired) AS BIGINT), round(sum(score), 6) FROM c GROUP BY ALL"""))
def yesno_pair_report(src: Source) -> DataFrame:
    supers = {"rush": ["1-URGENT", "2-HIGH"], "calm": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    report = R.paired(src.view(FX.PAIRS), by=(), pos="idx", supers=supers)
    return report.withColumn("score", F.round("score", 6))


@query(with_view(FX.PACKED_KEYS, """,
    k AS (SELECT category, l2_category, score, string_split(idx, '_')[4] AS s, string_split(idx, '_')[5] AS f, string_split(idx, '_')[6] AS q FROM fx),
    l AS (SELECT 'overall' AS level, 'Overall' AS key, * FROM k UNION ALL SELECT 'category', category, * FROM k
          UNION ALL SELECT 'l2_category', l2_category, * FROM k),
    a AS (SELECT level, key, count(*) AS n, sum(score)::DOUBLE / count(*) * 100 AS aAcc FROM l GROUP BY ALL),
    fg AS (SELECT level, key, avg(m) * 100 AS fAcc FROM (SELECT level, key, l2_category, s, f, min(score) AS m FROM l GROUP BY ALL) GROUP BY ALL),
    qg AS (SELECT level, key, avg(m) * 100 AS qAcc FROM (SELECT level, key, l2_category, s, q, min(score) AS m FROM l GROUP BY ALL) GROUP BY ALL)
    SELECT a.level, a.key, a.n, round(aAcc, 6) AS aAcc, round(fAcc, 6) AS fAcc, round(qAcc, 6) AS qAcc, round((aAcc + fAcc + qAcc) / 3, 6) AS mean_acc
    FROM a JOIN fg ON a.level = fg.level AND a.key = fg.key JOIN qg ON a.level = qg.level AND a.key = qg.key"""))
def yesno_hallucination_report(src: Source) -> DataFrame:
    report = R.hallucination(src.view(FX.PACKED_KEYS), by=(), index="idx")
    return report.select("level", "key", "n", *[F.round(c, 6).alias(c) for c in ("aAcc", "fAcc", "qAcc", "mean_acc")])


@query(with_view(FX.MCQ, "," + S.infer("fx", S.ABCD) + """, sc AS (SELECT *, CAST(coalesce(opt, 'Z') = answer AS INT) AS hit FROM inferred)
    SELECT split AS dataset, model, 'none' AS split, 'overall' AS level, 'Overall' AS key, count(*) AS n, sum(hit)::DOUBLE / count(*) AS score FROM sc GROUP BY ALL"""))
def concat_evaluation(src: Source) -> DataFrame:
    """Two data sets evaluated as one combined set, and reported under their own names and indices again."""
    rows = src.view(FX.MCQ).withColumnRenamed("idx", "index")
    parts = {name: rows.where(F.col("split") == name).drop("split", "prediction", "model") for name in ("dev", "test")}
    merged = PR.concat_datasets(parts).withColumn("dataset", F.lit("both"))
    predictions = rows.select("index", "model", "prediction", F.col("split").alias("sub_dataset"))
    answered = merged.join(predictions.withColumnRenamed("index", "original_index"), ["original_index", "sub_dataset"])
    own = PR.split_concat(SC.score_options(answered.withColumn("gt", F.col("answer")), ABCD))
    return R.accuracy(own, by=("dataset", "model"), l2=None, category=None)
