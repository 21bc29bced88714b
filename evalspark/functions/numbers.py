"""Number parsing and numeric comparison with the tolerances used by the scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T

_DIGITS = "[0-9](?:_?[0-9])*"
_INT = f"^[+-]?{_DIGITS}$"
_FLOAT = f"(?i)^[+-]?(?:(?:{_DIGITS}\\.?(?:{_DIGITS})?|\\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def parse_int(c: Column | str) -> Column:
    """``int(text)``, NULL where that fails (SQL casts accept more and less than Python does)."""
    bare = T.strip(T.col(c))
    return F.when(bare.rlike(_INT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def same_int(a: Column | str, b: Column | str) -> Column:
    """Whether two texts are the same whole number, however long; NULL where one is none."""
    def plain(c: Column | str) -> Column:
        bare = F.replace(T.strip(T.col(c)), F.lit("_"), F.lit(""))
        digits = F.ltrim(F.ltrim(bare, F.lit("+-")), F.lit("0"))
        signed = F.when(bare.startswith("-") & (digits != ""), F.concat(F.lit("-"), digits)).otherwise(digits)
        return F.when(T.strip(T.col(c)).rlike(_INT), signed)

    return plain(a) == plain(b)


def parse_float(c: Column | str) -> Column:
    """``float(text)``, NULL where that fails."""
    bare = T.strip(T.col(c))
    return F.when(bare.rlike(_FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def parse_percent(c: Column | str) -> Column:
    """A number, with a trailing ``%`` meaning hundredths."""
    text = T.col(c)
    percent = parse_float(F.rtrim(text, F.lit("%"))) / 100.0
    return F.when(F.endswith(text, F.lit("%")), percent).otherwise(parse_float(text))


def relaxed_match(target: Column | str, prediction: Column | str, tolerance: float = 0.05) -> Column:
    """Numbers within a relative tolerance of ``target``; otherwise equality ignoring case."""
    target, prediction = T.col(target), T.col(prediction)
    t, p = parse_percent(target), parse_percent(prediction)
    change = F.try_divide(F.abs(p - t), F.abs(t))
    same = F.lower(prediction) == F.lower(target)
    numeric = p.isNotNull() & t.isNotNull() & (t != 0)
    return F.when(numeric, F.coalesce(change <= tolerance, F.lit(False))).otherwise(same)


def decimals(x: Column) -> Column:
    """Digits after the point in the shortest decimal form of a double, 3 where that form has no point."""

    def width(text: Column) -> Column:
        fraction = F.split_part(F.split_part(text, F.lit("E"), F.lit(1)), F.lit("."), F.lit(2))
        exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
        digits = F.when(fraction == "0", 0).otherwise(F.length(fraction))
        shown = F.when(digits > 0, digits + 2 + F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2))).otherwise(3)
        return (
            F.when(exponent.isNull(), F.length(fraction))
            .when((exponent < -4) | (exponent >= 16), shown)
            .otherwise(F.greatest(digits - exponent, F.lit(1)))
        )

    return T.let(x.cast("string"), width)


def close_number(gold: Column, pred: Column, *, percentage: bool = True, relative: float | None = 0.01) -> Column:
    """Gold, gold/100 or gold*100 within 1 % of the prediction, or equal after rounding."""

    def equal_rounded(g: Column, p: Column) -> Column:
        # Two or more equal decimals need a gap of at most 0.01, which is cheap to rule out first.
        places = F.greatest(F.least(decimals(p), decimals(g)), F.lit(2))
        same = T.let(F.pow(F.lit(10.0), places), lambda scale: F.rint(p * scale) == F.rint(g * scale))
        return (F.abs(g - p) <= 0.0101) & same

    def close(g: Column, p: Column) -> Column:
        if relative is None:
            return equal_rounded(g, p)
        return (F.abs(g - p) <= relative * F.greatest(F.abs(g), F.abs(p))) | equal_rounded(g, p)

    def any_close(p: Column) -> Column:
        candidates = F.array(gold / 100, gold, gold * 100) if percentage else F.array(gold)
        return F.exists(candidates, lambda g: close(g, p))

    finite = ~F.isnan(pred) & ~F.isnan(gold)
    return F.coalesce(F.when(finite, T.let(pred, any_close)), F.lit(False))


def score_pair(review: Column | str) -> tuple[Column, Column]:
    """Two numbers on the first line of a review; (-1, -1) otherwise."""
    line = F.replace(F.get(F.split(T.col(review), "\n"), F.lit(0)), F.lit(","), F.lit(" "))
    parts = F.split(line, " ")
    first, second = parse_float(F.get(parts, F.lit(0))), parse_float(F.get(parts, F.lit(1)))
    ok = (F.size(parts) == 2) & first.isNotNull() & second.isNotNull()
    return F.when(ok, first).otherwise(-1.0), F.when(ok, second).otherwise(-1.0)


def unit_score(reply: Column | str) -> Column:
    """A number in [0, 1], NULL when the reply is anything else."""
    value = parse_float(reply)
    return F.when((value >= 0) & (value <= 1), value)


def small_integer(reply: Column | str) -> Column:
    """Integer reply, -1 when it is not one."""
    return F.coalesce(parse_int(reply), F.lit(-1))


def image_tokens(height: Column | str, width: Column | str, detail: str = "high") -> Column:
    """Token estimate of an image: 85 plus 170 per 512-pixel tile after shrinking to 1024."""
    if detail == "low":
        return F.lit(85)
    h, w = T.col(height).cast("bigint"), T.col(width).cast("bigint")
    big = (w > 1024) | (h > 1024)
    new_h = F.when(~big, h).when(w > h, F.floor(h * 1024 / w)).otherwise(1024)
    new_w = F.when(~big, w).when(w > h, 1024).otherwise(F.floor(w * 1024 / h))
    return (85 + 170 * F.ceil(new_h / 512) * F.ceil(new_w / 512)).cast("int")


def completion_budget(max_tokens: Column | int, window: Column | int, used: Column) -> Column:
    """Tokens left for a reply, NULL when the prompt fills the window (the row is then a failure)."""
    left = F.least(F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens,
                   (F.lit(window) if isinstance(window, int) else window) - used)
    return F.when(left > 0, left)


def text_tokens(c: Column | str) -> Column:
    """Token estimate of a text when no tokeniser is given: a quarter of its characters, rounded up."""
    return F.ceil(F.length(T.col(c)) / 4).cast("bigint")


def budget_reply(max_tokens: int, window: int, used: Column) -> Column:
    """Failure text for rows whose prompt does not fit."""
    fits = completion_budget(max_tokens, window, used).isNotNull()
    return F.when(~fits, K.FAIL_MESSAGE + "Input string longer than context window. ")
