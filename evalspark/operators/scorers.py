"""Row scorers: predictions in, ``hit`` / ``score`` columns out.  No shuffle unless an answer table is joined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import denotations as D
from evalspark.functions import documents as DOC
from evalspark.functions import expressions as X
from evalspark.functions import json_text as J
from evalspark.functions import numbers as N
from evalspark.functions import text as T
from evalspark.operators import keys as OK

Options = Mapping[str, Column | str]


# ------------------------------------------------------------------ multiple choice
def open_questions_as_options(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows without option A get their answer as A and ``Other Answers`` as B."""
    open_row = F.col("A").isNull()
    return df.withColumns({
        "B": F.when(open_row, "Other Answers").otherwise(F.col("B")),
        "A": F.when(open_row, F.col(answer)).otherwise(F.col("A")),
    })


def gold_letter(answer: Column | str) -> Column:
    """Answer letter; answers that are not one capital letter count as A."""
    return F.when(T.col(answer).rlike("^[A-Z]\\z"), T.col(answer)).otherwise("A")


def score_options(df: DataFrame, options: Options, gold: str = "gt", prediction: str = "prediction") -> DataFrame:
    """Adds ``opt`` (NULL: undecided), ``hit`` and ``log``."""
    text = T.as_text(prediction)
    scored = df.withColumn("opt", A.infer_option(prediction, options))
    log = F.when(F.col("opt").isNull(), K.NO_JUDGE_LOG).otherwise(text)
    return scored.withColumns({
        "hit": F.coalesce((F.coalesce("opt", F.lit("Z")) == F.col(gold)).cast("int"), F.lit(0)),
        "log": F.concat(F.lit("Match Log: "), log, F.lit(". ")),
    })


def score_mcq(
    predictions: DataFrame, answers: DataFrame, options: Options, keys: Sequence[str] = ("index",), pos: str | None = None
) -> DataFrame:
    """Predictions with a known answer, scored by letter or option text."""
    return score_options(OK.attach_answers(predictions, answers, keys, pos=pos), options)


def guess_option(key: Column, letters: Column) -> Column:
    """Stable stand-in for a random pick among the options and Z."""
    pool = F.array_union(letters, F.array(F.lit("Z")))
    return F.get(pool, F.pmod(F.xxhash64(key), F.size(pool)).cast("int"))


def score_real_world(df: DataFrame) -> DataFrame:
    """First-letter scoring; ``rejected`` marks rows without a letter (score 0)."""
    return df.withColumn("extracted", A.first_letter_ae("prediction")).withColumns({
        "score": F.coalesce((F.col("extracted") == F.col("answer")).cast("int"), F.lit(0)),
        "rejected": F.col("extracted") == "",
    })


def score_video_choice(df: DataFrame) -> DataFrame:
    """First letter, else the options written in the question; no letter at all counts as Z."""
    letter = A.first_letter_ad("prediction")
    staged = df.withColumn("_letter", letter).withColumn("_options", A.options_in_question("question"))
    by_options = A.infer_option_map("prediction", F.col("_options"))
    extracted = F.coalesce(F.when(F.col("_letter") != "", F.col("_letter")), by_options, F.lit("Z"))
    return (
        staged.withColumn("extracted", extracted)
        .withColumn("score", F.coalesce((F.col("extracted") == F.col("answer")).cast("int"), F.lit(0)))
        .drop("_letter", "_options")
    )


def score_video_options(df: DataFrame) -> DataFrame:
    """Head match against ``(X) answer``, else the inferred letter; failed calls score -1."""
    candidates = T.list_or_empty("candidates")
    _, gold = A.lettered_candidates(candidates, "answer")
    staged = df.withColumn("_gold", gold)
    letter = A.infer_option_map("prediction", T.letters_for(candidates))
    gold_letter_col = F.substring("_gold", 2, 1)
    hit = A.option_match("prediction", "_gold") | F.coalesce(letter == gold_letter_col, F.lit(False))
    return staged.withColumn(
        "score", F.when(T.is_failure("prediction"), -1).otherwise(hit.cast("int"))
    ).drop("_gold")


# ------------------------------------------------------------------ yes / no
def score_yes_no(df: DataFrame) -> DataFrame:
    """Adds ``extracted`` (Yes/No/Unknown) and ``score`` (0/1)."""
    return df.withColumn("extracted", A.yes_no(A.tagged_answer(T.as_text("prediction")))).withColumn(
        "score", F.coalesce((F.col("answer") == F.col("extracted")).cast("int"), F.lit(0))
    )


# ------------------------------------------------------------------ open answers with a list of golds
def match_list(golds: Column, prediction: Column | str, method: str) -> Column:
    """Match value of every gold: ``consensus``, ``anls`` (a distance), ``relaxed``, ``exact`` or ``equal``."""
    text = T.as_text(prediction)
    if method == "consensus":
        normal = F.transform(golds, lambda g: T.normalise_answer(g))

        def shares(names: Column, pred: Column) -> Column:
            same = F.size(F.filter(names, lambda g: g == pred))
            return T.let(same, lambda n: F.transform(names, lambda g: F.least(F.lit(1.0), (n - (g == pred).cast("int")) / 3.0)))

        return T.let(
            T.normalise_answer(A.phrased_answer(text)), lambda pred: T.let(normal, lambda names: shares(names, pred))
        )
    if method == "anls":
        return T.let(A.phrased_answer(text), lambda pred: F.transform(golds, lambda g: T.edit_share(g, pred)))
    if method == "relaxed":
        pred = A.phrased_answer(T.strip(text))
        return T.let(pred, lambda p: F.transform(golds, lambda g: N.relaxed_match(p, g).cast("double")))
    if method == "exact":
        pred = T.strip(F.lower(text))
        return T.let(pred, lambda p: F.transform(golds, lambda g: (T.strip(F.lower(g)) == p).cast("double")))
    if method == "equal":
        pred = T.normalise_answer(text)
        return T.let(pred, lambda p: F.transform(golds, lambda g: (T.normalise_answer(g) == p).cast("double")))
    raise ValueError(f"unknown match method {method!r}")


def reduce_matches(matches: Column, how: str, threshold: float = 0.5) -> Column:
    """Mean, max, or one minus the smallest distance (below the threshold: 0)."""
    if how == "mean":
        total = F.aggregate(matches, F.lit(0.0), lambda a, x: a + x)
        return F.try_divide(total, F.size(matches))
    if how == "max":
        return F.array_max(matches)
    if how == "anls":
        best = 1 - F.array_min(matches)
        return F.when(best < threshold, 0.0).otherwise(best)
    raise ValueError(f"unknown reduction {how!r}")


# Data set family -> (match method, reduction).
VQA_METHODS: dict[str, tuple[str, str]] = {
    "consensus": ("consensus", "mean"),
    "anls": ("anls", "anls"),
    "relaxed": ("relaxed", "max"),
    "exact": ("exact", "max"),
    "exact_mean": ("exact", "mean"),
}


def score_vqa(df: DataFrame, family: str = "consensus", answer: str = "answer", prediction: str = "prediction") -> DataFrame:
    """Adds ``hit`` for an answer cell holding one gold or a list of golds."""
    method, how = VQA_METHODS[family]
    return (
        df.withColumn("_golds", T.to_list(T.as_text(answer)))
        .withColumn("_match", match_list(F.col("_golds"), prediction, method))
        .withColumn("hit", reduce_matches(F.col("_match"), how))
        .drop("_golds", "_match")
    )


def score_ocr(df: DataFrame) -> DataFrame:
    """1 when any gold is part of the prediction; formulas ignore spaces, other text ignores case."""

    def flat(c: Column) -> Column:
        return F.replace(T.strip(c), F.lit("\n"), F.lit(" "))

    golds, text = T.list_or_empty("answer"), T.as_text("prediction")
    plain_text = flat(F.lower(text))
    packed_text = F.replace(flat(text), F.lit(" "), F.lit(""))
    plain = T.let(plain_text, lambda t: F.exists(golds, lambda g: F.contains(t, flat(F.lower(g)))))
    packed = T.let(
        packed_text, lambda t: F.exists(golds, lambda g: F.contains(t, F.replace(flat(g), F.lit(" "), F.lit(""))))
    )
    hit = F.when(F.col("category") == K.OCR_FORMULA, packed).otherwise(plain)
    return df.withColumn("hit", F.coalesce(hit.cast("int"), F.lit(0)))


def score_containment(df: DataFrame) -> DataFrame:
    """1 when the gold, without periods and case, is part of the prediction."""

    def flat(c: Column) -> Column:
        return F.replace(T.strip(F.lower(c)), F.lit("."), F.lit(""))

    return df.withColumn("hit", F.contains(flat(T.as_text("prediction")), flat(T.as_text("answer"))).cast("int"))


# ------------------------------------------------------------------ tables
def score_table_truth(df: DataFrame) -> DataFrame:
    """True/false statements; ``score`` is NULL when the prediction says both."""
    pred = F.lower(F.coalesce("prediction", F.lit("none")))
    yes, no = F.contains(pred, F.lit("true")), F.contains(pred, F.lit("false"))
    right = (yes & (F.col("answer") == "1")) | (no & (F.col("answer") == "0"))
    return df.withColumn("score", F.when(~(yes & no), F.coalesce(right.cast("int"), F.lit(0))))


def score_table_denotation(df: DataFrame) -> DataFrame:
    """Lists of table values compared as sets of numbers, dates and texts."""
    items = df.withColumns({
        "_gold": D.unescape_list("answer"),
        "_pred": D.unescape_list(F.replace(F.col("prediction"), F.lit("||"), F.lit("|"))),
    })
    valued = items.withColumns({"_gold_v": D.cell_values("_gold"), "_pred_v": D.cell_values("_pred")})
    score = D.same_denotation(F.col("_gold_v"), F.col("_pred_v")).cast("int")
    return valued.withColumn("score", score).drop("_gold", "_pred", "_gold_v", "_pred_v")


def score_table_financial(df: DataFrame) -> DataFrame:
    """Adds ``exact_score`` and ``score`` (any of the readings with or without units agree)."""
    staged = df.withColumns({"_g": D.normalise_cell("answer"), "_p": D.normalise_cell("prediction")})
    valued = staged.withColumns({"_gv": D.financial_value("_g"), "_pv": D.financial_value("_p")})
    exact, relaxed = D.financial_match(F.col("_gv"), F.col("_pv"))
    return valued.withColumns({"exact_score": exact.cast("int"), "score": relaxed.cast("int")}).drop("_g", "_p", "_gv", "_pv")


# ------------------------------------------------------------------ maths
def _maths_option(response: Column | str) -> Column:
    return A.infer_option_map(response, T.letters_for(T.list_or_empty("choices")))


def prefetch_maths(df: DataFrame) -> DataFrame:
    """Adds ``prefetched``: the option, integer or number readable without a judge (0 is not one)."""
    number = N.parse_float("prediction")
    value = (
        F.when(F.col("question_type") == "multi_choice", _maths_option("prediction"))
        .when((F.col("answer_type") == "integer") & (N.same_int("prediction", "answer")),
              F.nullif(N.parse_int("prediction"), F.lit(0)).cast("string"))
        .when((F.col("answer_type") == "float") & (number == N.parse_float("answer")) & (number != 0), F.col("prediction"))
    )
    return df.withColumn("prefetched", value)


def score_maths(df: DataFrame, strict: bool = False) -> DataFrame:
    """Typed comparison of ``res`` and the answer.

    Text and list answers never score unless ``strict``, which compares their text.
    """
    text_hit = (T.strip(F.col("res")) == T.strip(F.col("answer"))) if strict else (F.col("answer") == "None")
    hit = (
        F.when(F.col("question_type") == "multi_choice", _maths_option("res") == F.col("answer_option"))
        .when(F.col("answer_type") == "integer", N.same_int("res", "answer"))
        .when(F.col("answer_type") == "float", N.parse_float("res") == N.parse_float("answer"))
        .otherwise(text_hit)
    )
    return df.withColumn("hit", F.coalesce(hit.cast("int"), F.lit(0)))


def score_maths_expression(df: DataFrame) -> DataFrame:
    """Option letter when there are choices, else equal text or equal value."""
    staged = df.withColumns({"_a": X.evaluate(T.strip(F.lower("res"))), "_g": X.evaluate(T.strip(F.lower("answer")))})
    same = X.same_maths(T.as_text("res"), T.as_text("answer"), F.col("_a"), F.col("_g"))
    letter = F.lower(_maths_option("res")) == T.strip(F.lower(F.col("answer")))
    hit = F.when(F.size(T.list_or_empty("choices")) > 0, letter).otherwise(same)
    return staged.withColumn("hit", F.coalesce(hit.cast("int"), F.lit(0))).drop("_a", "_g")


# ------------------------------------------------------------------ documents and slides
def score_document(df: DataFrame) -> DataFrame:
    return df.withColumn("score", DOC.typed_score("answer", "pred", "answer_format"))


def score_document_anls(df: DataFrame) -> DataFrame:
    return df.withColumn("score", T.edit_similarity(F.lower(DOC.answer_or_default("answer")), F.lower("pred")))


def score_slides(df: DataFrame) -> DataFrame:
    """Adds ``anls``, ``em`` and ``f1``."""
    staged = df.withColumns({
        "_g": F.lower(F.replace(DOC.answer_or_default("answer"), F.lit("\n"), F.lit(""))),
        "_p": F.lower(T.as_text("pred")),
    })
    return staged.withColumns({
        "anls": T.edit_similarity("_g", "_p"),
        "em": (T.strip("_g") == T.strip("_p")).cast("int"),
        "f1": T.bag_of_words_f1("_g", "_p"),
    }).drop("_g", "_p")


# ------------------------------------------------------------------ judged replies
def score_judged_unit(df: DataFrame, reply: str = "reply") -> DataFrame:
    return df.withColumn("score", F.coalesce(N.unit_score(reply), F.lit(0.0)))


def score_judged_pair(df: DataFrame, reply: str = "reply") -> DataFrame:
    first, second = N.score_pair(reply)
    return df.withColumns({"gpt4_score": first, "score": second})


def score_judged_dimensions(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``dims`` (``map<dimension, int>``; missing or unreadable dimensions are NULL)."""
    staged = df.withColumn("_raw", J.dimension_scores(reply))
    pairs = [x for d in K.DIALOGUE_DIMENSIONS for x in (F.lit(d), J.dimension_value(F.col("_raw"), d))]
    return staged.withColumn("dims", F.create_map(*pairs)).drop("_raw")


def score_judged_integer(df: DataFrame, reply: str = "reply") -> DataFrame:
    """0-3 reply as integer; no reply, or anything else, is -1."""
    return df.withColumn("score", N.small_integer(reply).cast("int"))


def missing_dimensions(dims: Column) -> Column:
    """Names of the dimensions a judge reply lacks."""
    named = [F.when(F.try_element_at(dims, F.lit(d)).isNull(), F.lit(d)) for d in K.DIALOGUE_DIMENSIONS]
    return F.array_compact(F.array(*named))
