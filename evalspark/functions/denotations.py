"""Table-answer normalisation and comparison.

Unicode decomposition and the clean-up loop have no SQL form, so reading a cell is a small Arrow function;
splitting cells, scaling units and comparing sets of values stay in Spark expressions.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark import constants as K
from evalspark.functions import numbers as N
from evalspark.functions import text as T

# Patterns of the clean-up loop.
_SINGLE_QUOTES = re.compile("[‘’´`]")
_DOUBLE_QUOTES = re.compile("[“”]")
_DASHES = re.compile("[‐‑‒–—−]")
_CITATION = re.compile(r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$")
_DETAIL = re.compile(r"(?<!^)( \([^)]*\))*$")
_QUOTED = re.compile(r'^"([^"]*)"$')


def _to_plain_marks(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    text = "".join(ch for ch in decomposed if unicodedata.category(ch) != "Mn")
    for pattern, plain in ((_SINGLE_QUOTES, "'"), (_DOUBLE_QUOTES, '"'), (_DASHES, "-")):
        text = pattern.sub(plain, text)
    return text


def _normalise(text: str) -> str:
    text = text.replace("`", "'") if text.isascii() else _to_plain_marks(text)
    before = None
    while text != before:
        before = text
        for pattern, keep in ((_CITATION, ""), (_DETAIL, ""), (_QUOTED, r"\1")):
            text = pattern.sub(keep, text.strip())
    return " ".join(text.removesuffix(".").lower().split())


@F.pandas_udf(ST.StringType())
def normalise_cell(cells: pd.Series) -> pd.Series:
    """Table text without marks, citations, trailing details and outer quotes."""
    known = {cell: _normalise(cell) for cell in cells.dropna().unique()}
    return cells.map(known.get, na_action="ignore")


_VALUE = ST.StructType([
    ST.StructField("kind", ST.StringType()), ST.StructField("num", ST.DoubleType()),
    ST.StructField("key", ST.StringType()), ST.StructField("norm", ST.StringType()),
])


def _number(text: str) -> float | None:
    """Finite number written in a cell; whole when it is within 1e-6 of one."""
    try:
        value = float(text)
    except ValueError:
        return None
    if not math.isfinite(value):
        return None
    return float(int(value)) if abs(value - round(value)) < 1e-6 else value


def _date(text: str) -> tuple[int, ...] | None:
    """Year, month and day of ``y-m-d``; ``xx`` parts are -1; NULL when it is not a date."""
    parts = text.lower().split("-")
    if len(parts) != 3:
        return None
    wild = [p == "xx" or (i == 0 and p == "xxxx") for i, p in enumerate(parts)]
    try:
        ymd = tuple(-1 if w else int(p) for p, w in zip(parts, wild, strict=True))
    except ValueError:
        return None
    in_range = all(v == -1 or 1 <= v <= top for v, top in zip(ymd[1:], (12, 31), strict=True))
    return ymd if in_range and set(ymd) != {-1} else None


def _typed(text: str) -> dict:
    number, date, norm = _number(text), _date(text), _normalise(text)
    if number is None and date is not None and date[1:] == (-1, -1):
        number = float(date[0])
    if number is not None:
        return {"kind": "number", "num": number, "key": repr(number), "norm": norm}
    if date is not None:
        return {"kind": "date", "num": None, "key": "-".join(map(str, date)), "norm": norm}
    return {"kind": "text", "num": None, "key": norm, "norm": norm}


@F.pandas_udf(ST.ArrayType(_VALUE))
def cell_values(cells: pd.Series) -> pd.Series:
    """Distinct typed values of an array of cells; the first of equal values is kept."""
    typed = functools.cache(_typed)  # cells repeat within a batch

    def values(items: list[str]) -> list[dict]:
        return list({(v["kind"], v["key"]): v for v in map(typed, reversed(list(items)))}.values())[::-1]

    return cells.map(values, na_action="ignore")


def unescape_list(c: Column | str) -> Column:
    """Items of a ``|``-separated cell with ``\\n``, ``\\p`` and ``\\\\`` escapes resolved."""

    def unescape(x: Column) -> Column:
        x = F.replace(x, F.lit("\\n"), F.lit("\n"))
        x = F.replace(x, F.lit("\\p"), F.lit("|"))
        return F.replace(x, F.lit("\\\\"), F.lit("\\"))

    return F.transform(F.split(T.col(c), "\\|"), unescape)


def _same_value(a: Column, b: Column) -> Column:
    numbers = (a["kind"] == "number") & (b["kind"] == "number") & (F.abs(a["num"] - b["num"]) < 1e-6)
    dates = (a["kind"] == "date") & (b["kind"] == "date") & (a["key"] == b["key"])
    return (a["norm"] == b["norm"]) | F.coalesce(numbers, F.lit(False)) | dates


def same_denotation(gold: Column, pred: Column) -> Column:
    """Equal set sizes and every gold value matches some predicted value."""
    return (F.size(gold) == F.size(pred)) & F.forall(gold, lambda g: F.exists(pred, lambda p: _same_value(g, p)))


def financial_value(norm: Column | str) -> Column:
    """Struct ``(is_number, num, num_free, text, text_free)`` of a normalised financial cell."""
    s = F.translate(T.col(norm), "$(),", "")
    unit_words = "|".join(K.UNIT_WORDS)
    s = F.regexp_replace(s, f"(?iU)\\b({unit_words})s?\\b", "")
    scaled, free = s, s
    for lead in (" ", ""):
        for word, power in K.UNIT_SCALES.items():
            scaled = F.regexp_replace(scaled, f"(?U){lead}\\b{word}\\b", power)
            free = F.regexp_replace(free, f"(?U){lead}\\b{word}\\b", "")
    scaled = F.regexp_replace(scaled, " ?%", K.PERCENT_SCALE)
    free = F.regexp_replace(free, " ?%", "")
    num, num_free = N.parse_float(scaled), N.parse_float(free)
    return F.struct(
        (num.isNotNull() & num_free.isNotNull()).alias("is_number"),
        num.alias("num"), num_free.alias("num_free"), scaled.alias("text"), free.alias("text_free"),
    )


def _equal_number(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def financial_match(gold: Column, pred: Column) -> tuple[Column, Column]:
    """(exact, relaxed) equality of two :func:`financial_value` structs."""
    both = gold["is_number"] & pred["is_number"]
    neither = ~gold["is_number"] & ~pred["is_number"]
    exact = (both & _equal_number(gold["num"], pred["num"])) | (neither & (gold["text"] == pred["text"]))
    number_pair, text_pair = F.lit(False), F.lit(False)
    for g, p in (("", ""), ("", "_free"), ("_free", ""), ("_free", "_free")):
        number_pair = number_pair | _equal_number(gold["num" + g], pred["num" + p])
        text_pair = text_pair | (gold["text" + g] == pred["text" + p])
    relaxed = (both & number_pair) | (neither & text_pair)
    return F.coalesce(exact, F.lit(False)), F.coalesce(relaxed, F.lit(False))
