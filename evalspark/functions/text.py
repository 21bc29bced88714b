"""Text primitives whose results equal those of the Python string methods of the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K

_SPACE_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.PY_SPACE) + "]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, chars: str = K.PY_SPACE) -> Column:
    """``str.strip`` (SQL TRIM alone removes spaces only)."""
    return F.btrim(col(c), F.lit(chars))


def words(c: Column | str) -> Column:
    """``str.split()``: runs of white space separate, no empty items."""
    return F.array_remove(F.split(col(c), _SPACE_RUN), "")


def collapse_space(c: Column | str) -> Column:
    return F.array_join(words(c), " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for every array item."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def as_text(c: Column | str, null_text: str = "nan") -> Column:
    """Text of a cell; a missing cell reads ``nan`` as it does in a data frame turned to text."""
    return F.coalesce(col(c).cast("string"), F.lit(null_text))


def contains_any(c: Column | str, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(col(c), F.lit(needle))
    return hit


def list_in_text(needles: Column, c: Column | str) -> Column:
    """True when any item of an array is a substring of the text."""
    return let(col(c), lambda text: F.exists(needles, lambda x: F.contains(text, x)))


def is_failure(c: Column | str) -> Column:
    return F.contains(as_text(c), F.lit(K.FAIL_MESSAGE))


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike("[\\u4e00-\\u9fff]")


def is_refusal(c: Column | str) -> Column:
    return (
        contains_any(c, K.REFUSAL_WORDS)
        | contains_any(F.lower(col(c)), K.REFUSAL_WORDS_ANY_CASE)
        | contains_any(c, K.REFUSAL_WORDS_CJK)
    )


def to_list(c: Column | str) -> Column:
    """A cell holding a list literal becomes an array; any other cell becomes a one-item array."""
    text = col(c)
    parsed = F.from_json(text, "array<string>")
    return F.when(text.rlike("(?s)^\\[.*\\]$"), F.coalesce(parsed, F.array(text))).otherwise(F.array(text))


def list_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def clean_punctuation(c: Column | str, removals: int | None = None) -> Column:
    """Delete or blank the listed marks, then drop periods that no digit follows.

    A mark is deleted when it stands next to a space anywhere in the text or when the text holds a
    digit-comma-digit run; otherwise it becomes a space.  ``removals`` limits how many periods are dropped.
    """
    text = col(c)
    marks = "".join(K.PUNCTUATION_MARKS)
    one = "[" + "".join("\\" + m for m in K.PUNCTUATION_MARKS) + "]"
    beside_space = F.array_join(F.regexp_extract_all(text, F.lit(f"{one}(?= )|(?<= ){one}"), F.lit(0)), "")
    deleted = F.when(text.rlike("\\d,\\d"), marks).otherwise(beside_space)
    out = F.translate(F.call_function("translate", text, deleted, F.lit("")), marks, " " * len(marks))
    return F.array_join(F.split(out, "\\.(?!\\d)", -1 if removals is None else removals + 1), "")


def normalise_words(c: Column | str) -> Column:
    """Lower case, number words to digits, articles dropped, contractions restored."""
    numbers = _literal_map(K.NUMBER_WORDS)
    contractions = _literal_map(K.CONTRACTIONS)
    tokens = F.transform(words(F.lower(col(c))), lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    kept = F.filter(tokens, lambda w: ~w.isin(K.ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(contractions, w), w)), " ")


def normalise_answer(c: Column | str) -> Column:
    spaced = F.translate(col(c), "\n\t", "  ")
    return normalise_words(clean_punctuation(strip(spaced)))


def _literal_map(values: dict[str, str]) -> Column:
    """Map constant, folded when the plan is optimised."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in values.items())), F.lit(";"), F.lit("="))


def edit_share(a: Column | str, b: Column | str) -> Column:
    """Edit distance over the longer length of the raw texts, on lower-cased text with single spaces."""
    a, b = col(a), col(b)
    distance = F.levenshtein(collapse_space(F.lower(a)), collapse_space(F.lower(b)))
    longest = F.greatest(F.length(F.upper(a)), F.length(F.upper(b)))
    return F.when(longest == 0, 0.0).otherwise(distance / longest)


def edit_similarity(a: Column | str, b: Column | str, threshold: float = 0.5) -> Column:
    """One minus the edit distance share; values at or below the threshold are 0."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(F.upper(a)), F.length(F.upper(b)))
    share = F.coalesce(F.levenshtein(a, b) / F.nullif(longest, F.lit(0)), F.when(longest == 0, 0.0))
    return let(1.0 - share, lambda s: F.when(s <= threshold, 0.0).otherwise(s))


def bag_of_words_f1(gold: Column | str, pred: Column | str) -> Column:
    """F1 whose overlap counts prediction words (with repeats) that occur in the gold text."""

    def f1(common: Column, n_gold: Column, n_pred: Column) -> Column:
        recall, precision = common / n_gold, common / n_pred
        return F.when(recall + precision > 1e-4, 2 * recall * precision / (recall + precision)).otherwise(0.0)

    def score(g: Column, p: Column) -> Column:
        common = F.size(F.filter(p, lambda w: F.array_contains(g, w))).cast("double")
        both = (F.size(g) > 0) & (F.size(p) > 0)
        return F.when(both, let(common, lambda c: f1(c, F.size(g), F.size(p)))).otherwise(0.0)

    return let(words(gold), lambda g: let(words(pred), lambda p: score(g, p)))


def split_key(c: Column | str, part: int) -> Column:
    """Part ``part`` (from 0) of a ``_``-packed key, NULL when absent."""
    return F.try_element_at(F.split(col(c), "_"), F.lit(part + 1))


def letters_for(items: Column) -> Column:
    """Map A.. to the items of an array."""
    n = F.size(items)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.char(i + 64))
    return F.map_from_arrays(F.slice(keys, 1, n), items)


def letter_at(position: Column) -> Column:
    """Letter of a 0-based option position; -1 gives ``@``."""
    return F.char(position + 65)
