"""Answer extraction from free text: option letters, yes/no, tagged and phrased answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T


def last_option_tag(c: Column | str, last_letter: str = "D") -> Column:
    """Letter of the last ``Answer: X`` tag, else the whole text."""
    text = T.col(c)
    up, low = last_letter.upper(), last_letter.lower()
    tags = F.regexp_extract_all(text, F.lit(f"(?U)Answer:\\s*([A-{up}a-{low}])(?![A-Za-z])"), F.lit(1))
    return F.coalesce(F.try_element_at(tags, F.lit(-1)), text)


def last_bilingual_tag(c: Column | str) -> Column:
    """Letter of the last English or Chinese answer tag (A-D), else the whole text."""
    text = T.col(c)
    pattern = "(?U)(答案|Answer|answer)(：|:)\\s*([a-dA-D])(?![A-Za-z])"
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(3)), F.lit(-1)), text)


def tagged_answer(c: Column | str) -> Column:
    """Everything after the first ``Answer:``, stripped; the text itself when there is no tag."""
    text = T.col(c)
    rest = F.regexp_extract(text, "(?s)Answer:(.*)", 1)
    return F.when(F.contains(text, F.lit("Answer:")), T.strip(rest)).otherwise(text)


def phrased_answer(c: Column | str) -> Column:
    """Text after ``Answer:``, or between ``answer is`` and the next period; any case."""
    text = T.col(c)
    tag, phrase = "(?is)answer:(.*)", "(?isU)answer\\s+is\\s+([^.]*)"
    return (
        F.when(text.rlike(tag), T.strip(F.regexp_extract(text, tag, 1)))
        .when(text.rlike(phrase), T.strip(F.regexp_extract(text, phrase, 1)))
        .otherwise(text)
    )


def _option_tokens(answer: Column) -> Column:
    return T.words(F.translate(answer, K.OPTION_SEPARATORS, " " * len(K.OPTION_SEPARATORS)))


def _single(items: Column) -> Column:
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def _option_from_tokens(answer: Column, letters: Column) -> Column:
    tokens = _option_tokens(answer)
    named = F.array_intersect(tokens, letters)
    return (
        F.when(F.contains(answer, F.lit(K.FAIL_MARKER)), F.lit(None).cast("string"))
        .when(T.contains_any(answer, K.REFUSAL_SENTENCES), "Z")
        .when(F.size(named) == 1, F.get(named, F.lit(0)))
        .when((F.size(named) == 0) & F.array_contains(tokens, "Z"), "Z")
    )


def present_letters(options: Mapping[str, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(T.col(v).isNotNull(), F.lit(k)) for k, v in options.items()]))


def option_letter(answer: Column | str, options: Mapping[str, Column | str]) -> Column:
    """The one option letter that stands alone in the answer; ``Z`` for a refusal; NULL otherwise."""
    return _option_from_tokens(T.col(answer), present_letters(options))


def option_by_text(answer: Column | str, options: Mapping[str, Column | str]) -> Column:
    """The one option whose text occurs in the answer, ignoring case."""
    lowered = F.lower(T.col(answer))
    hits = [
        F.when(F.contains(lowered, F.lower(T.col(v).cast("string"))), F.lit(k)) for k, v in options.items()
    ]
    return _single(F.array_compact(F.array(*hits)))


def infer_option(answer: Column | str, options: Mapping[str, Column | str], null_text: str = "nan") -> Column:
    """Option letter by letter, else by option text, NULL when neither is unambiguous."""
    answer = T.as_text(answer, null_text)
    return F.coalesce(option_letter(answer, options), option_by_text(answer, options))


def infer_option_map(answer: Column | str, options: Column, null_text: str = "nan") -> Column:
    """:func:`infer_option` for options held in a ``map<letter, text>`` column."""
    answer = T.as_text(answer, null_text)
    lowered = F.lower(answer)
    by_text = F.map_keys(F.map_filter(options, lambda k, v: F.contains(lowered, F.lower(v))))
    return F.coalesce(_option_from_tokens(answer, F.map_keys(options)), _single(by_text))


def option_map(options: Mapping[str, Column | str]) -> Column:
    """``map<letter, text>`` of the options that are present."""
    pairs = [x for k, v in options.items() for x in (F.lit(k), T.col(v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _without_lead_ins(c: Column, lead_ins: list[str]) -> Column:
    out = T.strip(c)
    for sentence in lead_ins:
        out = F.replace(out, F.lit(sentence), F.lit(""))
    return out


def first_letter_ae(c: Column | str) -> Column:
    """First of A-E after lead-ins are removed; ``''`` when rejected; option labels as fall-back."""
    rest = _without_lead_ins(F.coalesce(T.col(c), F.lit("")), K.LEAD_INS_AE)
    lowered = F.lower(rest)
    has_letter = rest.rlike("[ABCDE]")
    out = F.when(has_letter, F.regexp_extract(rest, "[ABCDE]", 0)).when(F.size(T.words(rest)) > 10, "")
    for letter in "ABCDE":
        out = out.when(F.contains(F.lit(f"({letter.lower()})"), lowered), letter)
    return F.when(T.col(c).isNull(), "").otherwise(out.otherwise(""))


def first_letter_ad(c: Column | str) -> Column:
    """First of A-D after lead-ins are removed, ``''`` when there is none."""
    return F.regexp_extract(_without_lead_ins(T.as_text(c), K.LEAD_INS_AD), "[ABCD]", 0)


def options_in_question(question: Column | str) -> Column:
    """Option texts written on lines 2.. of a question as ``A. text``, as ``map<letter, text>``."""
    lines = F.split(T.col(question), "\n")
    tail = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))

    def entry(line: Column, i: Column) -> Column:
        label = F.concat(T.letter_at(i), F.lit("."))
        value = T.strip(F.substr(line, F.instr(line, label) + 2), ". \n")
        return F.when(F.contains(line, label), F.struct(T.letter_at(i).alias("key"), value.alias("value")))

    return F.map_from_entries(F.array_compact(F.transform(tail, entry)))


def yes_no(c: Column | str) -> Column:
    """``Yes`` or ``No`` when exactly one of the words occurs, else ``Unknown``."""
    tokens = T.words(T.clean_punctuation(F.lower(T.as_text(c))))
    yes, no = F.array_contains(tokens, "yes"), F.array_contains(tokens, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def option_block(options: Column) -> Column:
    """Options of a ``map<letter, text>`` as the listing used in judge prompts."""
    lines = F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n")))
    return F.concat(F.lit(K.OPTIONS_HEADER), F.array_join(lines, ""))


def lettered_candidates(candidates: Column, answer: Column | str) -> tuple[Column, Column]:
    """``(A) x`` lines of candidates, and the answer with the letter of its last equal candidate."""
    answer = T.col(answer)
    lines = F.transform(candidates, lambda c, i: F.concat(F.lit("("), T.letter_at(i), F.lit(") "), c))
    places = F.filter(
        F.transform(candidates, lambda c, i: F.when(c == answer, i)), lambda i: i.isNotNull()
    )
    position = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(-1))
    return lines, F.concat(F.lit("("), T.letter_at(position), F.lit(") "), answer)


def option_match(pred: Column | str, gold: Column | str) -> Column:
    """First words agree: one is contained in the other (periods of the prediction ignored)."""
    pred_head = F.get(F.split(F.lower(T.col(pred)), " "), F.lit(0))
    gold_head = F.get(F.split(F.lower(T.col(gold)), " "), F.lit(0))
    return F.contains(gold_head, F.replace(pred_head, F.lit("."), F.lit(""))) | F.contains(pred_head, gold_head)


def option_match_advanced(pred: Column | str, gold: Column | str) -> Column:
    """:func:`option_match`, or the gold content (single digits as words) occurs in the prediction."""
    pred, gold = F.lower(T.col(pred)), F.lower(T.col(gold))
    parts = F.split(gold, " ")
    content = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    bare = T.strip(F.regexp_replace(content, "\\.$", ""), ". \n")
    spelled = F.create_map(*[F.lit(x) for i, w in enumerate(K.DIGIT_WORDS) for x in (str(i), w)])
    digit = F.regexp_extract(bare, "^[+]?0*(\\d)$", 1)
    needle = F.coalesce(F.try_element_at(spelled, digit), bare)
    return option_match(pred, gold) | F.contains(T.strip(pred, ". \n"), needle)


def fold_category(category: Column | str, sub: Column | str) -> tuple[Column, Column, Column]:
    """``task/subtask`` plus a lower-cased path in which any attribute path is cut to its first part."""
    parts = F.split(T.col(category), "/")
    path = F.lower(T.col(sub))
    folded = F.when(F.contains(path, F.lit("attribute")), F.concat(F.get(F.split(path, "/"), F.lit(0)), F.lit("/attribute")))
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.coalesce(folded, path)
