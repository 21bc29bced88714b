"""Judge prompts and prompt policies.

Judge texts use this project's own wording; what they fix is the slots and the form of the reply that the
parsers in :mod:`evalspark.functions` read.  Policies are data: one row per data set family.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import messages as M
from evalspark.functions import text as T

_OPTION_JUDGE = {
    "en": (
        "Decide which option a reply chose. Below are a question, its options and the reply of another system. "
        "Write the letter of the option whose meaning is closest to the reply, and nothing else. "
        "Write Z when no option is close.\n"
    ),
    "refusal": (
        "Decide which option a reply chose. Below are a question, its options and the reply of another system. "
        "Write the letter of the option whose meaning is closest to the reply, and nothing else. "
        "Write Z when no option is close, and also when the reply refuses to answer or asks for the image.\n"
    ),
    "cn": (
        "请判断下面的回答选择了哪个选项。给出问题、选项和回答，只写出与回答含义最接近的选项字母；如果没有接近的选项，写 Z。\n"
    ),
}
_YES_NO_JUDGE = (
    "Decide whether a reply to a question means Yes or No. Write one word: Yes, No, or Unknown when it means neither.\n"
)
_EXTRACT_JUDGE = (
    "Read a question and a reply. Write only the final answer that the reply gives: a number, a letter, a word or a "
    "list, without explanation.\n"
)
_OPEN_SCORE_JUDGE = (
    "Compare a reply with the expected answer. <AND> means that every part must be present, <OR> that one part is "
    "enough. Write one number from 0.0 (wrong) to 1.0 (right), in steps of 0.1, and nothing else.\n"
)
_PAIR_JUDGE = (
    "Rate two replies to the same question from 1 to 10 each. On the first line write the two numbers with one space "
    "between them; explain on the next lines.\n"
)
_DIALOGUE_JUDGE = (
    "Rate one turn of a dialogue against its reference. Give a whole number from 0 to 10 for each of: "
    + ", ".join(K.DIALOGUE_DIMENSIONS)
    + ". End with one object in braces that maps each name to its number.\n"
)
_VIDEO_JUDGE = (
    "Rate how close a reply is to the expected answer in meaning. Write one whole number: 0 unrelated, 1 mostly wrong, "
    "2 mostly right, 3 same meaning.\n"
)
_DOCUMENT_JUDGE = (
    "Read a question about a document and an analysis. Write 'Extracted answer:' and the answer, then "
    "'Answer format:' and one of Int, Float, Str, List or None. Write 'Not answerable' when the document does not "
    "hold the answer and 'Fail to answer' when the analysis does not give one.\n"
)


def _fill(head: str | Column, *slots: tuple[str, Column | str], end: str = "") -> Column:
    head = F.lit(head) if isinstance(head, str) else head
    lines = [F.concat(F.lit(f"{name}: "), T.as_text(value, ""), F.lit("\n")) for name, value in slots]
    return F.concat(head, *lines, F.lit(end))


def option_judge(question: Column | str, options: Column, prediction: Column | str, *, refusal: bool = False) -> Column:
    """Prompt for reading an option out of a reply; Chinese for questions with Chinese text."""
    head = F.lit(_OPTION_JUDGE["refusal"]) if refusal else (
        F.when(T.has_cjk(question), _OPTION_JUDGE["cn"]).otherwise(_OPTION_JUDGE["en"])
    )
    return _fill(head, ("Question", question), ("Options", A.option_block(options)), ("Reply", prediction), end="Letter: ")


def yes_no_judge(question: Column | str, prediction: Column | str) -> Column:
    return _fill(_YES_NO_JUDGE, ("Question", question), ("Reply", prediction), end="Word: ")


def extraction_judge(question: Column | str, prediction: Column | str) -> Column:
    return _fill(_EXTRACT_JUDGE, ("Question", question), ("Reply", prediction), end="Extracted answer: ")


def open_score_judge(question: Column | str, answer: Column | str, prediction: Column | str) -> Column:
    spaced = F.replace(F.replace(T.col(answer), F.lit("<AND>"), F.lit(" <AND> ")), F.lit("<OR>"), F.lit(" <OR> "))
    return _fill(_OPEN_SCORE_JUDGE, ("Question", question), ("Expected", spaced), ("Reply", prediction), end="Score: ")


def pair_judge(
    caption: Column | str, question: Column | str, first: Column | str, second: Column | str
) -> Column:
    return _fill(_PAIR_JUDGE, ("Context", caption), ("Question", question), ("Reply 1", first), ("Reply 2", second))


def dialogue_judge(question: Column | str, reference: Column | str, prediction: Column | str) -> Column:
    return _fill(_DIALOGUE_JUDGE, ("Question", question), ("Reference", reference), ("Reply", prediction))


def video_judge(question: Column | str, answer: Column | str, prediction: Column | str) -> Column:
    return _fill(_VIDEO_JUDGE, ("Question", question), ("Expected", answer), ("Reply", prediction), end="Number: ")


def document_judge(question: Column | str, prediction: Column | str) -> Column:
    return _fill(_DOCUMENT_JUDGE, ("Question", question), ("Analysis", prediction))


@dataclass(frozen=True)
class PromptPolicy:
    """How one family of data sets is asked.

    ``names``: substrings of data set names (empty: any); ``without``: names that are left out; ``exact``: ``names`` are whole names;
    ``kinds``: task kinds; ``system``: separate first text; ``prefix``/``suffix``: around the text; ``with_options``: a choice text, with
    ``labels`` for question and options or without, and with other texts for rows that have no options.
    """

    names: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    exact: bool = False
    system: str = ""
    prefix: str = ""
    suffix: str = ""
    with_options: bool = False
    labels: bool = True
    system_without_options: str = ""
    prefix_without_options: str = ""
    suffix_cn: str = ""
    trimmed: bool = False

    def applies(self, dataset: Column, kind: Column) -> Column:
        if self.names:
            named = dataset.isin(list(self.names)) if self.exact else T.contains_any(dataset, list(self.names))
        else:
            named = F.lit(True)
        if self.without:
            named = named & ~T.contains_any(dataset, list(self.without))
        return named & (kind.isin(list(self.kinds)) if self.kinds else F.lit(True))


# First matching row wins.
STEP_BY_STEP_POLICIES: tuple[PromptPolicy, ...] = (
    PromptPolicy(names=K.STEP_BY_STEP_SETS, kinds=("MCQ",), prefix=K.STEP_BY_STEP_OPTIONS, prefix_without_options=K.STEP_BY_STEP_SHORT, with_options=True, labels=False),
    PromptPolicy(names=K.STEP_BY_STEP_SETS, kinds=("Y/N",), prefix=K.STEP_BY_STEP_SHORT),
    PromptPolicy(names=("OCRBench",), kinds=("VQA",), prefix=K.STEP_BY_STEP_OCR),
    PromptPolicy(names=K.STEP_BY_STEP_SETS, kinds=("VQA",), prefix=K.STEP_BY_STEP_SHORT),
    PromptPolicy(names=K.STEP_BY_STEP_SETS),
    PromptPolicy(kinds=("MCQ",), suffix=K.LETTER_ONLY, with_options=True, system_without_options=K.DIRECT_ANSWER),
    PromptPolicy(names=("HallusionBench",), suffix=K.YES_OR_NO_QUESTION),
    PromptPolicy(names=("LLaVABench",), kinds=("VQA",)),
    PromptPolicy(names=("MMVet",), kinds=("VQA",), system=K.DETAILED_ANSWER),
    PromptPolicy(kinds=("VQA",), system=K.SHORT_ANSWER),
    PromptPolicy(),
)
SHORT_ANSWER_POLICIES: tuple[PromptPolicy, ...] = (
    PromptPolicy(names=("MMMU",), suffix=K.MCQ_SELECT["en"], with_options=True, trimmed=True),
    PromptPolicy(kinds=("MCQ",), suffix=K.MCQ_SELECT["en"], suffix_cn=K.MCQ_SELECT["cn"], with_options=True, trimmed=True),
    PromptPolicy(names=("HallusionBench", "POPE"), exact=True, kinds=("Y/N",), suffix=K.YES_NO_SUFFIX),
    PromptPolicy(kinds=("VQA",), without=("MMVet",), suffix=K.SHORT_WORDS_SUFFIX),
    PromptPolicy(),
)


def policy_message(
    policies: Sequence[PromptPolicy],
    dataset: Column | str,
    kind: Column | str,
    question: Column | str,
    options: dict[str, Column | str],
    images: Column,
    hint: Column | str | None = None,
) -> Column:
    """Message of a row under the first policy that applies to its data set."""
    dataset, kind, question = T.col(dataset), T.col(kind), T.col(question)
    present = M.has_options(options)
    out = None
    for rule in policies:
        if rule.with_options:
            marks = {} if rule.labels else {"header": "", "question_label": ""}
            plain = M.mcq_text(question, options, hint, instruction="", **marks)
            suffix = F.lit(rule.suffix)
            if rule.suffix_cn:
                suffix = F.when(T.has_cjk(plain), rule.suffix_cn).otherwise(rule.suffix)
            body = F.concat(plain, F.when(present, suffix).otherwise(""))
            if rule.trimmed:
                body = F.regexp_replace(body, "\\s+\\z", "")
            system = F.when(~present, rule.system_without_options).otherwise(rule.system)
            prefix = F.when(present, rule.prefix).otherwise(rule.prefix_without_options)
        else:
            body = F.concat(question, F.lit(rule.suffix))
            system, prefix = F.lit(rule.system), F.lit(rule.prefix)
        head = F.when(system != "", F.array(M.part("text", system))).otherwise(
            F.slice(F.array(M.part("text", F.lit(""))), 1, 0)
        )
        message = F.concat(head, M.base_message(images, F.concat(prefix, body)))
        test = rule.applies(dataset, kind)
        out = F.when(test, message) if out is None else out.when(test, message)
    return out
