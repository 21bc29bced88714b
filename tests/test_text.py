"""Worked examples of the text functions, and random texts against plain-Python readings of the same rules."""

import random

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import answers as A
from evalspark.functions import documents as D
from evalspark.functions import json_text as J
from evalspark.functions import numbers as N
from evalspark.functions import text as T


def options():
    return {"A": F.lit("red"), "B": F.lit("green"), "C": F.lit("blue")}


def random_texts(seed, n=300, alphabet="ab AB.,:;()yesno 12-/\t\n\"é"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_strip_and_words_follow_python(column):
    texts = random_texts(1) + ["  x ", "\t\n", "\x1ca\x85"]
    assert column(T.strip("x"), texts) == [t.strip() for t in texts]
    assert column(T.words("x"), texts) == [t.split() for t in texts]


def py_punctuation(text):
    import re

    grouped = re.search(r"[0-9],[0-9]", text)
    out = "".join(
        ch if ch not in K.PUNCTUATION_MARKS else ("" if grouped or ch + " " in text or " " + ch in text else " ") for ch in text
    )
    kept = []
    for i, ch in enumerate(out):
        if ch != "." or out[i + 1 : i + 2].isdigit():
            kept.append(ch)
    return "".join(kept)


def test_punctuation_matches_the_rule(column):
    texts = random_texts(2) + ["1,000 (a)", "a-b", "a - b", "x." * 40, "3.5 .5 5.", "\\ \\"]
    assert column(T.clean_punctuation("x"), texts) == [py_punctuation(t) for t in texts]


def test_answer_normalisation(column):
    cases = {"The  Two\tdogs": "2 dogs", "dont": "don't", "none of an apple": "0 of apple", "ten-ten": "10 10", "A": ""}
    assert column(T.normalise_answer("x"), list(cases)) == list(cases.values())


def test_option_tags(column):
    texts = ["Answer: A", "Answer: a then Answer:\n B", "Answer: Apple", "answer: A", "none", "Answer: E"]
    assert column(A.last_option_tag("x"), texts) == ["A", "B", "Answer: Apple", "answer: A", "none", "Answer: E"]
    assert column(A.last_option_tag("x", "I"), texts)[-1] == "E"
    assert column(A.last_bilingual_tag("x"), ["答案：b", "Answer：c and answer:d", "回答"]) == ["b", "d", "回答"]


def test_tagged_and_phrased_answers(column):
    assert column(A.tagged_answer("x"), ["so Answer: \n yes Answer: no ", "answer: x", ""]) == ["yes Answer: no", "answer: x", ""]
    texts = ["The answer is 5. Done", "ANSWER: x \n", "the final answer is  cat", "answer is .", "nothing", "answer\nis\nx.y"]
    assert column(A.phrased_answer("x"), texts) == ["5", "x", "cat", "", "nothing", "x"]


def test_option_inference(column):
    cases = {
        "A": "A", "(B).": "B", "A or B": None, "A, A": "A", "Z": "Z", "The colour is GREEN": "B", "red green": None, "": None,
        "Cannot determine the answer": "Z", "Failed to obtain answer via API. red": "A", "Is it A? I think so": None, "Is it A ? I think so": "A", "Zebra": None,
        "D": None, "a": None,
    }
    assert column(A.infer_option("x", options()), list(cases)) == list(cases.values())
    as_map = A.infer_option_map("x", A.option_map(options()))
    assert column(as_map, list(cases)) == list(cases.values())


def test_null_prediction_reads_nan(column):
    assert column(A.infer_option("x", {"A": F.lit("an"), "B": F.lit("b")}), [None]) == ["A"]


def test_first_letters(column):
    cases = {"The best answer is (C)": "C", "": "A", "b": "B", "(": "A", "nothing here": "", "I think so, maybe, or not, it is hard to say now": "",
             "The best option isThe correct option is D": "D", None: ""}
    assert column(A.first_letter_ae("x"), list(cases)) == list(cases.values())
    assert column(A.first_letter_ad("x"), ["Answer: D", "Option: none", "E", None]) == ["D", "", "", ""]
    # A lead-in that is half of a run is not removed, so its own capital letters count.
    assert column(A.first_letter_ad("x"), ["Best answer: C"]) == ["B"]


def test_options_in_question(column):
    q = "Which?\nA. red.\n B.green \nno label\nD. x"
    assert column(A.options_in_question("x"), [q, "none"]) == [{"A": "red", "B": "green", "D": "x"}, {}]


def test_yes_no(column):
    cases = {"Yes, it is": "Yes", "no": "No", "yes and no": "Unknown", "maybe": "Unknown", "YES!": "Yes", "know": "Unknown", "yes/no": "Unknown"}
    assert column(A.yes_no("x"), list(cases)) == list(cases.values())


def test_option_heads(column):
    pairs = [("(A) yes", "(A) red"), ("a.", "(A) red"), ("b", "(A) red"), ("", "(A) red"), ("it is three", "(C) 3.")]
    assert column(A.option_match("p", "g"), pairs, "p string, g string") == [True, True, False, True, False]
    assert column(A.option_match_advanced("p", "g"), pairs, "p string, g string") == [True, True, False, True, True]


def test_candidates(column):
    lines, gold = A.lettered_candidates(F.split("c", ","), "a")
    rows = [("x,y,x", "x"), ("x,y", "z")]
    assert column(gold, rows, "c string, a string") == ["(C) x", "(@) z"]
    assert column(lines, rows, "c string, a string")[1] == ["(A) x", "(B) y"]


def python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_number_parsing_follows_python(column):
    texts = ["1", " 2 ", "1_0", "1d", "0x1p3", "1e5", ".5", "5.", "-3.2e-2", "+1", "1__0", "_1", "", "e5", "1f", "--1", "12.7"]
    assert column(N.parse_float("x"), texts) == [python_float(t) for t in texts]
    ints = ["1", "-7", "1_000", "14.0", "", "0x1", " 5\n", "１"]
    assert column(N.parse_int("x"), ints) == [1, -7, 1000, None, None, None, 5, None]


def test_relaxed_match(column):
    pairs = [("100", "105", True), ("100", "106", False), ("0", "0", True), ("5%", "0.05", True), ("a", "A", True), ("0", "0.0", False), ("nan", "1", False)]
    got = column(N.relaxed_match("p", "g"), [p[:2] for p in pairs], "p string, g string")
    assert got == [p[2] for p in pairs]


def test_decimals_follow_repr(column):
    values = [0.1, 12.0, 1e-05, 1.2e-05, 0.00012, 1e7, 1.5e16, 1e16, 123456.789, 0.5]
    expected = [len(repr(v).split(".")[-1]) if "." in repr(v) else 3 for v in values]
    assert column(N.decimals(F.col("x")), values, "x double") == expected


def test_close_number(column):
    rows = [(50.0, 0.5), (0.5, 50.0), (100.0, 100.9), (100.0, 102.0), (1.0, 0.0149), (1.0, float("nan"))]
    assert column(N.close_number(F.col("g"), F.col("p")), rows, "g double, p double") == [True, True, True, False, True, False]


def test_typed_document_scores(column):
    rows = [("7", "7.9", "Int"), ("7", "x", "Int"), ("$12.50", "12.5", "Float"), ("0.5", "50%", "Float"), ("cat", "cats", "Str"),
            ("page 3", "page 4", "Str"), ("['a', 'b']", "['b', 'a']", "List"), ("['a']", "['a', 'b']", "List"), ("['1', '2']", "['1', '3']", "List"),
            ("None", "None", "None")]
    got = column(D.typed_score("g", "p", "f"), rows, "g string, p string, f string")
    assert got == [1.0, 0.0, 1.0, 1.0, 0.75, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_clean_string(column):
    assert column(D.clean_string("x"), ["'Tom' (note)", "$5%", ' "x" ', "5 miles"]) == ["tom", "5", "x", "5 miles"]
    assert column(D.clean_string("x", strict=True), ["5 miles"]) == ["5"]


def test_extracted_answer(column):
    texts = ["Extracted answer: 5\nAnswer format: Int", "none", "Extracted answer: a Extracted answer: b"]
    assert column(D.extracted_answer("x"), texts) == ["5", "", "a"]


def test_json_in_text(column):
    cases = {
        'x {"1": "a", "2": 3} y': {"1": "a", "2": "3"}, "no": None, '{"a": 1} {"b": 2}': None,
        '{ "1": "a",\n 2: b': {"1": "a", "2": "b"}, "{broken": {}, None: None,
    }
    assert column(J.answer_map("x"), list(cases)) == list(cases.values())


def test_dimension_scores(column):
    reply = "ok {'Creativity': 12, 'Richness': '3.7', 'Visual Perception': 'high'} end"
    names = ["Creativity", "Richness", "Visual Perception", "Overall Score"]
    got = [column(J.dimension_value(J.dimension_scores("x"), n), [reply, "none"]) for n in names]
    assert got == [[10, None], [3, None], [None, None], [None, None]]


def test_score_pair(column):
    first, second = N.score_pair("x")
    texts = ["8 9\nbecause", "8, 9", "7", "7.5 8", "a b"]
    assert column(first, texts) == [8.0, -1.0, -1.0, 7.5, -1.0]
    assert column(second, texts) == [9.0, -1.0, -1.0, 8.0, -1.0]


def test_bag_of_words_f1(column):
    rows = [("a b", "a a b"), ("a", ""), ("x", "y")]
    recall, precision = 3 / 2, 1.0
    assert column(T.bag_of_words_f1("g", "p"), rows, "g string, p string") == [2 * recall * precision / (recall + precision), 0.0, 0.0]


def test_similarity_thresholds(column):
    rows = [("ab", "ab"), ("ab", "ax"), ("abc", "abx"), ("", "")]
    assert column(T.edit_similarity("a", "b"), rows, "a string, b string") == [1.0, 0.0, 1 - 1 / 3, 1.0]
    assert column(T.edit_share("a", "b"), [("A  b", "a b"), ("", "")], "a string, b string") == [0.0, 0.0]


def test_list_cells(column):
    assert column(T.to_list("x"), ["['a', \"b\"]", "plain", "[oops", '["x"]']) == [["a", "b"], ["plain"], ["[oops"], ["x"]]


def test_whole_numbers_of_any_length(column):
    pairs = [("12", "012"), ("1" * 30, "1" * 30), ("1" * 30, "1" * 29 + "2"), ("-0", "0"), ("-5", "5"), ("+7", " 7 "), ("1_000", "1000"), ("x", "x"), ("-" + "9" * 25, "-00" + "9" * 25)]
    assert column(N.same_int("a", "b"), pairs, "a string, b string") == [True, True, False, True, False, True, True, None, True]
