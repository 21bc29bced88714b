"""Typed answer comparison for document questions (Int, Float, Str, List)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import numbers as N
from evalspark.functions import text as T


def clean_string(c: Column | str, strict: bool = False) -> Column:
    """Lower case without parentheses, one outer quote per side, currency and percent signs.

    ``strict`` also removes a trailing ``mile``, ``miles`` or ``million``.
    """
    s = T.strip(F.lower(T.col(c)))
    if strict:
        s = T.strip(F.regexp_replace(s, "(miles?|million)$", ""))
    s = T.strip(F.regexp_replace(s, "(?U)\\s*\\([^)]*\\)", ""))
    s = T.strip(F.regexp_replace(s, "^['\"]|['\"]\\z", ""))
    s = T.strip(F.ltrim(s, F.lit("$")))
    return T.strip(F.rtrim(s, F.lit("%")))


def needs_exact_match(c: Column | str) -> Column:
    """Addresses, files, page names, phone numbers, times, dates and e-mail must match exactly."""
    s = T.col(c)
    return (
        F.contains(s, F.lit("https://"))
        | F.endswith(s, F.lit(".py"))
        | F.endswith(s, F.lit("ipynb"))
        | F.startswith(s, F.lit("page"))
        | s.rlike("^\\d+(-\\d+|\\s\\d+)?\\z")
        | T.contains_any(s, ["a.m.", "p.m."])
        | s.rlike("^\\d{4}[-\\s]\\d{2}([-\\s]\\d{2})?\\z")
        | s.rlike("^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\z")
    )


def _items(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.array(c))


def typed_score(gold: Column | str, pred: Column | str, answer_format: Column | str) -> Column:
    """Score of one answer by its declared format; anything that cannot be compared scores 0."""
    gold, pred, kind = T.col(gold), T.col(pred), T.col(answer_format)

    def whole(p: Column) -> Column:
        return F.when(p.between(-9.2e18, 9.2e18), p.cast("bigint"))

    int_score = (N.parse_int(gold) == T.let(N.parse_float(pred), whole)).cast("double")

    def number_score(g: Column, p: Column) -> Column:
        return N.close_number(g, p).cast("double")

    float_score = T.let(
        N.parse_float(clean_string(gold)), lambda g: T.let(N.parse_float(clean_string(pred)), lambda p: number_score(g, p))
    )

    def word_score(g: Column, p: Column) -> Column:
        return F.when(needs_exact_match(g), (g == p).cast("double")).otherwise(T.edit_similarity(g, p))

    text_score = T.let(clean_string(gold), lambda g: T.let(clean_string(pred), lambda p: word_score(g, p)))

    def items_score(golds: Column, preds: Column) -> Column:
        head = F.get(golds, F.lit(0))
        exact = N.parse_float(head).isNotNull() | needs_exact_match(head)
        worst = F.array_min(F.zip_with(golds, preds, lambda g, p: T.edit_similarity(g, p)))
        return (
            F.when(F.size(golds) != F.size(preds), 0.0)
            .when(exact, (F.array_join(golds, "-") == F.array_join(preds, "-")).cast("double"))
            .otherwise(worst)
        )

    def cleaned(c: Column) -> Column:
        return F.array_sort(F.transform(_items(c), lambda x: clean_string(x)))

    list_score = T.let(cleaned(gold), lambda g: T.let(cleaned(pred), lambda p: items_score(g, p)))
    score = (
        F.when(kind == "Int", int_score)
        .when(kind == "Float", float_score)
        .when(kind == "Str", text_score)
        .otherwise(list_score)
    )
    return F.coalesce(score, F.lit(0.0))


def extracted_answer(reply: Column | str) -> Column:
    """Text between ``Extracted answer:`` and ``Answer format:``; ``''`` when missing."""
    before = F.get(F.split(T.col(reply), "Answer format:"), F.lit(0))
    return F.coalesce(T.strip(F.get(F.split(before, "Extracted answer:"), F.lit(1))), F.lit(""))


def answer_or_default(c: Column | str) -> Column:
    return F.coalesce(T.col(c), F.lit(K.NOT_ANSWERABLE))


def page_group(position: Column, pages: Column, groups: int | None = None) -> Column:
    """Group number of a page: ``groups`` even chunks, or the fewest chunks averaging at most 20 pages."""
    if groups is None:
        k = F.greatest(F.ceil(pages / K.MAX_PAGE_COLUMNS), F.lit(1))
    else:
        k = F.lit(groups)
    size = F.greatest(F.ceil(pages / k), F.lit(1))
    return F.floor(position / size).cast("int")
