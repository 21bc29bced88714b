"""Pieces of the DuckDB texts that several oracle queries share."""

from __future__ import annotations

from evalspark import constants as K

# White space of str.split, as one regular-expression class.
SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.PY_SPACE) + "]"
_SPACE_CHARS = " || ".join(f"chr({ord(c)})" for c in K.PY_SPACE)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_SPACE_CHARS})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def join(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, {lit(by)}), '')"


def punctuation(x: str) -> str:
    """Nested replacements of the marks, then removal of periods no digit follows."""
    out = x
    for mark in K.PUNCTUATION_MARKS:
        m, before, after = lit(mark), lit(" " + mark), lit(mark + " ")
        test = f"contains({x}, {after}) OR contains({x}, {before}) OR regexp_matches({x}, '[0-9],[0-9]')"
        out = f"replace({out}, {m}, CASE WHEN {test} THEN '' ELSE ' ' END)"
    kept = f"regexp_replace({out}, '\\.([0-9])', chr(1) || '\\1', 'g')"
    return f"replace(replace({kept}, '.', ''), chr(1), '.')"


def mapping(values: dict[str, str], x: str) -> str:
    entries = ", ".join(f"{lit(k)}: {lit(v)}" for k, v in values.items())
    return f"coalesce(map_extract_value(MAP {{{entries}}}, {x}), {x})"


def normal_words(x: str) -> str:
    articles = ", ".join(lit(a) for a in K.ARTICLES)
    tokens = f"list_transform({words(f'lower({x})')}, lambda w: {mapping(K.NUMBER_WORDS, 'w')})"
    kept = f"list_filter({tokens}, lambda w: w NOT IN ({articles}))"
    return join(f"list_transform({kept}, lambda w: {mapping(K.CONTRACTIONS, 'w')})")


def phrased(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '(?is)answer:') THEN {strip(f'''regexp_extract({x}, '(?is)answer:(.*)', 1)''')} "
        f"WHEN regexp_matches({x}, '(?is)answer\\s+is\\s+') THEN {strip(f'''regexp_extract({x}, '(?is)answer\\s+is\\s+([^.]*)', 1)''')} "
        f"ELSE {x} END"
    )


def infer(source: str, options: dict[str, str], pred: str = "prediction", name: str = "opt") -> str:
    """WITH entries that end in ``inferred``: the source with the option letter added."""
    letters = ", ".join(f"CASE WHEN {v} IS NOT NULL AND list_contains(tk, '{k}') THEN '{k}' END" for k, v in options.items())
    texts = ", ".join(f"CASE WHEN contains(lower(p0), lower({v})) THEN '{k}' END" for k, v in options.items())
    refusals = " OR ".join(f"contains(p0, {lit(s)})" for s in K.REFUSAL_SENTENCES)
    marks, blanks = lit(K.OPTION_SEPARATORS), lit(" " * len(K.OPTION_SEPARATORS))
    split = words(f"translate(p0, {marks}, {blanks})")
    return f"""
    i0 AS (SELECT *, coalesce({pred}, 'nan') AS p0 FROM {source}),
    i1 AS (SELECT *, {split} AS tk FROM i0),
    i2 AS (SELECT *, list_filter([{letters}], lambda x: x IS NOT NULL) AS nm,
                     list_filter([{texts}], lambda x: x IS NOT NULL) AS tx FROM i1),
    inferred AS (SELECT *, coalesce(
        CASE WHEN contains(p0, {lit(K.FAIL_MARKER)}) THEN NULL WHEN {refusals} THEN 'Z'
             WHEN len(nm) = 1 THEN nm[1] WHEN len(nm) = 0 AND list_contains(tk, 'Z') THEN 'Z' END,
        CASE WHEN len(tx) = 1 THEN tx[1] END) AS {name} FROM i2)"""


ABCD = {c: c for c in "ABCD"}


def means(source: str, by: str, levels: dict[str, str | None], value: str, scale: str = "1.0") -> str:
    """Long report as one SELECT: by, level, key, n, score."""
    parts = []
    for level, column in levels.items():
        key = "'Overall'" if column is None else column
        where = "" if column is None else f" WHERE {column} IS NOT NULL"
        lead = f"{by}, " if by else ""
        parts.append(
            f"SELECT {lead}'{level}' AS level, {key} AS key, count({value}) AS n, "
            f"sum({value})::DOUBLE / count({value}) * {scale} AS score FROM {source}{where} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)
