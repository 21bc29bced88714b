"""JSON objects written inside free text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark.functions import numbers as N
from evalspark.functions import text as T

_DECODER = json.JSONDecoder()
_SIDE_MARKS = ",\"'"


def _objects(text: str) -> Iterator[dict]:
    start = text.find("{")
    while start >= 0:
        try:
            value, end = _DECODER.raw_decode(text, start)
            yield value
            start = text.find("{", end)
        except ValueError:
            start = text.find("{", start + 1)


def _only_object(text: str | None) -> dict[str, str] | None:
    found = list(_objects(text or ""))
    if len(found) != 1:
        return None
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found[0].items()}


@F.pandas_udf(ST.MapType(ST.StringType(), ST.StringType()))
def only_object(texts: pd.Series) -> pd.Series:
    """The only JSON object in a text; NULL when there is none, or more than one."""
    return texts.map(_only_object)


def named_lines(text: Column) -> Column:
    """``name: value`` lines behind a text's only opening brace as a map, without marks around them; of a repeated name the last counts."""
    lines = F.split(F.substring_index(text, "{", -1), "\n")
    bare = lambda c: F.btrim(T.strip(c), F.lit(_SIDE_MARKS))
    fields = F.transform(lines, lambda line: F.split(T.strip(line), ": "))
    pairs = F.transform(F.filter(fields, lambda f: F.size(f) > 1), lambda f: F.struct(bare(f[0]).alias("key"), bare(f[1]).alias("value")))
    said = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = T.let(said, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last)


def answer_map(text: Column | str) -> Column:
    """The only JSON object in a text, else the named lines behind its only opening brace; NULL when there is neither."""
    text = T.col(text)
    one_brace = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) == 1
    return F.coalesce(only_object(text), F.when(one_brace, named_lines(text)))


def dimension_scores(reply: Column | str) -> Column:
    """``map<dimension, text>`` read from the outermost braces of a judge reply; NULL when unreadable."""
    text = T.col(reply)
    inner = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(inner != "", F.from_json(inner, "map<string,string>"))


def dimension_value(scores: Column, name: str) -> Column:
    """Whole part of one dimension's score clipped to 0-10, NULL when absent or not a number."""
    def clipped(value: Column) -> Column:
        inside = F.greatest(F.least(value, F.lit(10.0)), F.lit(0.0))
        return F.when(value.isNotNull() & ~F.isnan(value), inside.cast("bigint"))

    return T.let(F.try_element_at(scores, F.lit(name)), lambda text: T.let(N.parse_float(text), clipped))
