"""Operators against brute force on small inputs, including very uneven groups."""

import math
import os
import random
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import denotations as D
from evalspark.operators import batch as B
from evalspark.operators import captions as CA
from evalspark.operators import circular as C
from evalspark.operators import covered as CV
from evalspark.operators import expand as E
from evalspark.operators import intervals as I
from evalspark.operators import keys as OK
from evalspark.operators.order import block_in, number_rows, number_within
from evalspark.operators import scorers as SC
from evalspark.plans import answer_reports as AR
from evalspark.sources import delimited as DL
from evalspark.sources import preparation as PR
from evalspark.sources import tables as TB
from evalspark.streaming import incremental as INC

ABCD = {c: c for c in "ABCD"}


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_first_covering_span_is_exact(spark):
    rng = random.Random(5)
    # One video holds most spans and points; some spans are long, some empty.
    spans = [(i, "hot" if rng.random() < 0.8 else "cold", s, s + rng.choice([0, 1, 2, 7, 90, 5000, 30000]), f"t{i}")
             for i, s in ((i, rng.randrange(0, 20000)) for i in range(400))]
    points = [(i, "hot" if rng.random() < 0.8 else "cold", rng.randrange(0, 60000)) for i in range(500)] + [(500, "none", 5)]
    got = I.first_covering(
        spark.createDataFrame(points, "id int, video string, t_ms bigint"),
        spark.createDataFrame(spans, "pos int, video string, start_ms bigint, end_ms bigint, text string"), ["video"],
    )
    expected = {p: next((s[4] for s in spans if s[1] == v and s[2] < t < s[3]), None) for p, v, t in points}
    assert {r["id"]: r["text"] for r in got.collect()} == expected


@pytest.mark.parametrize("base,levels", [(2, 8), (4, 4), (8, 3), (4, 2)])
def test_blocks_cover_exactly(spark, base, levels):
    ranges = [(lo, lo + n) for lo in range(0, 40, 3) for n in (0, 1, 5, 16, 63, 200)]
    df = spark.createDataFrame(ranges, "lo bigint, hi bigint")
    for r in df.select("lo", "hi", I._blocks(F.col("lo"), F.col("hi"), base, levels).alias("b")).collect():
        covered = [t for b in r["b"] for t in range(b["block"] * base ** b["level"], (b["block"] + 1) * base ** b["level"])]
        assert sorted(covered) == list(range(r["lo"], r["hi"] + 1))


@pytest.mark.parametrize("split", ["128m", "2000", "300"])
def test_delimited_text_is_split(spark, tmp_path, split):
    """One file with line breaks, quotes, separators and empty cells inside quotes, cut anywhere: the same rows, by many tasks."""
    rng = random.Random(6)
    parts = ["a", "\n", '"', "\t", ",", " ", "é", "\r\n", "word", ""]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30))) + "x", None if i % 7 == 0 else f"v{i}") for i in range(400)]
    rows += [(400, "\n" * 3000 + "x", "long"), (401, "x", "end")]
    df = spark.createDataFrame(rows, "id bigint, text string, other string").coalesce(1)
    TB.write_table(df, f"{tmp_path}/one.tsv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(key, split if key.endswith("tionBytes") else "1")
        back = TB.read_table(spark, f"{tmp_path}/one.tsv", schema=df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
        lines = DL.numbered_lines(spark, f"{tmp_path}/one.tsv")
        assert lines.select("split").distinct().count() > 1
        texts = TB.read_table(spark, f"{tmp_path}/one.tsv")
        assert texts.columns == ["id", "text", "other"] and texts.count() == len(rows)
        with pytest.raises(ValueError):
            TB.read_table(spark, f"{tmp_path}/one.tsv", schema="id bigint, body string, other string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corrections_and_expiry(spark, tmp_path):
    """A later answer replaces an earlier one, late rows are left out, and old keys leave the state."""
    day = 86_400
    rows = [[("m", i, 0, i, 1) for i in range(50)], [("m", 49, 100, 60, 0), ("m", 100, 5 * day, 61, 1), ("m", 100, 5 * day, 62, 0)],
            [("m", 7, 200, 70, 0), ("m", 100, 5 * day - 10, 71, 1), ("m", 101, 20 * day, 72, 1)], [("m", 102, 20 * day, 73, 1)]]
    held = []
    for step in rows:
        df = spark.createDataFrame(step, "model string, idx bigint, s bigint, tie bigint, hit int").select("*", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = INC.read_stream(spark, f"{tmp_path}/in", df.schema, files_per_batch=1000)
        signed = INC.corrections(stream, ["model", "idx"], "ts", "tie", ["model", "hit"], delay_ms=day * 1000)
        query = INC.sum_corrections(signed, f"{tmp_path}/out", f"{tmp_path}/checkpoint", by=("model",))
        query.awaitTermination()
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    # 50 answers; one of them corrected; one new that is corrected at once; the late correction of 7 and the older answer to 100 do not count.
    report = INC.running_report(spark, f"{tmp_path}/out", by=("model",)).first()
    assert (report["n"], report["score"]) == (53, 51 / 53)
    assert held[0] == 50 and max(held[1:]) <= 3 and held[-1] <= 2


def test_corrections_share_states(spark, tmp_path):
    """Keys share a bounded number of states, as each costs a call; a bucket's keys are corrected apart."""
    for step, hit in enumerate((1, 0)):
        df = spark.range(0, 3 * INC.BUCKETS, 1 + step).selectExpr("'m' AS model", "id AS idx", f"id + {step * 100_000} AS tie", f"{hit} AS hit", f"timestamp_seconds({10**9 + step}) AS ts")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        signed = INC.corrections(INC.read_stream(spark, f"{tmp_path}/in", df.schema, files_per_batch=1000), ["model", "idx"], "ts", "tie", ["model", "hit"])
        query = INC.sum_corrections(signed, f"{tmp_path}/out", f"{tmp_path}/checkpoint", by=("model",))
        query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= INC.BUCKETS
    report = INC.running_report(spark, f"{tmp_path}/out", by=("model",)).first()
    assert (report["n"], report["score"]) == (3 * INC.BUCKETS, 0.5)


def test_gram_counts(spark):
    rows = [([[5, 1, 5, 5], [], [2]],), ([],), (None,), ([[1, 1], None],)]
    got = spark.createDataFrame(rows, "grams array<array<bigint>>").select(CA.gram_counts("grams").alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[(2, 4, 3, 10), (0, 0, 0, 0), (1, 1, 1, 1)], [], [], [(1, 2, 2, 4), (0, 0, 0, 0)]]


def test_spans_of_any_length(spark):
    """Spans of 100 hours beside short ones: few pieces, and the first in file order."""
    day = 86_400_000
    spans = [(i, "v", i * 977, i * 977 + (360_000_000 if i % 10 == 3 else 1500), f"t{i}") for i in range(200)] + [(200, "v", 5, 5, "empty")]
    points = [(i, "v", i * 7919 % (4 * day)) for i in range(2000)]
    frames = spark.createDataFrame(points, "id int, video string, t_ms bigint")
    lines = spark.createDataFrame(spans, "pos int, video string, start_ms bigint, end_ms bigint, text string")
    expected = {p: next((s[4] for s in spans if s[2] < t < s[3]), None) for p, _, t in points}
    assert {r["id"]: r["text"] for r in I.first_covering(frames, lines, ["video"]).collect()} == expected
    levels = I.levels_for(360_000_000)
    most = lines.select(F.max(F.size(I._blocks(F.col("start_ms") + 1, F.col("end_ms") - 1, 4, levels)))).first()[0]
    assert levels == 15 and most < 2 * 3 * levels


def test_rotations(spark):
    table = spark.createDataFrame(
        [(1, "w", "x", "y", "z", "B", "p"), (2, "w", "x", "y", None, "C", "p"), (3, "w", "x", None, None, "A", "p"),
         (4, "w", "x", "y", "None of these", "A", "p"), (5, "w", "x", "A and B", "all", "D", "p")],
        "index bigint, A string, B string, C string, D string, answer string, image string",
    )
    got = {(r["index"] % 10**6, r["index"] // 10**6): r for r in C.expand_rotations(table).collect()}
    assert sorted(k for k in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2), (5, 0), (5, 1)]
    assert [got[(1, 1)][c] for c in "ABCD"] == ["z", "w", "x", "y"] and got[(1, 1)]["answer"] == "C"
    assert [got[(4, 1)][c] for c in "ABCD"] == ["y", "w", "x", "None of these"]
    assert got[(5, 1)]["answer"] == "D" and got[(1, 2)]["image"] == "1" and got[(1, 0)]["image"] == "p"


def test_rotation_keeps_the_answer_text(spark):
    rng = random.Random(3)
    rows = [(i, *(f"o{i}{j}" for j in range(4)), rng.choice("ABCD")) for i in range(50)]
    table = spark.createDataFrame(rows, "index bigint, A string, B string, C string, D string, answer string")
    text = F.element_at(F.create_map(*[x for c in "ABCD" for x in (F.lit(c), F.col(c))]), F.col("answer"))
    seen = C.expand_rotations(table).select((F.col("index") % 10**6).alias("g"), text.alias("t")).distinct()
    assert seen.count() == 50


def test_big_indexes_raise_the_offset(spark):
    table = spark.createDataFrame([(10**6, "w", "x", None, None, "A")], "index bigint, A string, B string, C string, D string, answer string")
    assert sorted(r["index"] for r in C.expand_rotations(table).collect()) == [10**6, 10**6 + 10**7]


def circular_groups(spark):
    rows = [(1, "A", "A"), (10**6 + 1, "B", "B"), (2, "A", "B"), (10**6 + 2, "B", "B"), (3, "A", "?"), (10**6 + 3, "B", "B"),
            (4, "A", "?"), (10**6 + 4, "B", "C"), (10**6 + 5, "A", "A")]
    return spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], "index bigint, gt string, prediction string, A string, B string, C string, D string")


def test_circular_groups(spark):
    scored = C.score_circular(circular_groups(spark), ABCD)
    assert [(r["index"], r["hit"], r["n_open"]) for r in scored.orderBy("index").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 0, 1)]
    logs = {r["index"]: r["log"] for r in scored.collect()}
    assert logs[4].startswith("Failed in Prefetching Rolling 1: Answer is B") and logs[3] == K.NO_JUDGE_LOG
    assert [r["index"] for r in C.undecided_groups(scored).collect()] == [3]


def test_rotation_consistency(spark):
    rows = [(1, "A"), (10**6 + 1, "B"), (2, "A"), (10**6 + 2, "C"), (3, "A"), (10**6 + 3, "no"), (4, "D"), (10**6 + 4, "A"), (5, ""), (10**6 + 5, "A")]
    flags = {r["gid"]: (r["valid"], r["consistent"]) for r in C.rotation_flags(spark.createDataFrame(rows, "index bigint, prediction string")).collect()}
    assert flags == {1: (True, True), 2: (True, False), 3: (False, True), 4: (True, True), 5: (True, True)}


def test_precedence_with_a_hot_key(spark):
    rows = [("k", i) for i in range(3000)] + [(f"c{i}", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, pos int").repartition(8)
    last = OK.last_wins(df, ["key"], "pos")
    assert last.count() == 1001 and last.where("key = 'k'").first()["pos"] == 2999
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


def test_merge_and_resume(spark):
    a = spark.createDataFrame([(1, "a1"), (2, K.FAIL_MESSAGE)], "index int, prediction string")
    b = spark.createDataFrame([(1, "b1"), (3, "b3")], "index int, prediction string")
    assert rows_of(OK.merge_shards([a, b], ["index"]), "index") == [(1, "b1"), (2, K.FAIL_MESSAGE), (3, "b3")]
    assert rows_of(OK.resume(a, b, ["index"]), "index") == [(1, "b1"), (3, "b3")]
    assert rows_of(OK.resume(a, b, ["index"], ignore_failed=True), "index") == [(1, "b1"), (2, K.FAIL_MESSAGE), (3, "b3")]
    assert rows_of(OK.missing_keys(a, b, ["index"]), "index") == [(2,)]


def test_missing_runs(spark):
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    done = spark.createDataFrame([("m1", "a1"), ("m1", "a2"), ("m2", "a1")], "model string, dataset string")
    got = OK.missing_runs(models, ["a", "a1"], done, {"a": ["a1", "a2"]})
    assert rows_of(got, "model", "dataset") == [("m2", "a")]


@pytest.mark.parametrize("step", [1, 10**9])
def test_running_sum_over_a_long_group(spark, step):
    rows = [("hot", i * step, i % 7) for i in range(5000)] + [("cold", i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, pos bigint, v int").repartition(5)
    got = {(r["g"], r["pos"]): r["s"] for r in E.running_sum(df, ["g"], "pos", {"s": F.col("v").cast("bigint")}, blocks=40).collect()}
    total = 0
    for i in range(5000):
        assert got[("hot", i * step)] == total
        total += i % 7
    assert got[("cold", 9)] == 9


def test_row_numbers_are_dense(spark):
    rows = [(g, o) for g in range(3) for o in random.Random(g).sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "g int, o bigint").repartition(7)
    numbered = number_rows(df, ["g"], "o", "n", blocks=20).orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1500))
    assert [(r["g"], r["o"]) for r in numbered] == sorted(rows)


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(40)]), i) for g, n in (("hot", 3000), (None, 50), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o bigint, i int").repartition(7)
    got = number_within(df, ["g"], "o", "n", ties=["i"], blocks=20, total="all").collect()
    for g in ("hot", None, "one"):
        of = sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"] is not None, r["o"] or 0, r["i"]))
        assert [r["n"] for r in of] == list(range(sum(x[0] == g for x in rows))) and {r["all"] for r in of} == {len(of)}


def test_block_in_counts_bounds(spark):
    bounds = [-5, 0, 3, 3_000_000_000, 4_000_000_000]
    df = spark.createDataFrame([(x,) for x in [None, -6, -5, -1, 0, 2, 3, 4, 3_000_000_000, 5_000_000_000]], "x bigint")
    got = [r[0] for r in df.select(block_in(F.col("x"), bounds)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5]


def test_packs_need_no_single_task(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 500).alias("video"), F.col("id").alias("index"), F.lit("q").alias("question"))
    assert "SinglePartition" not in E.pack_questions(df)._jdf.queryExecution().executedPlan().toString()


def test_truncated_dialogues(spark):
    sizes = [("user", 5), ("assistant", 9), ("user", 3), ("assistant", 2)]
    df = spark.createDataFrame([(1, i, r, "x" * n) for i, (r, n) in enumerate(sizes)], "conv_id int, turn bigint, role string, text string")
    assert [E.truncate_dialogues(df, b).count() for b in (19, 18, 5, 4)] == [4, 2, 2, 0]


def test_packs_hold_every_question_once(spark):
    df = spark.createDataFrame([("hot", i * 7, f"q{i}") for i in range(1001)] + [("cold", 1, "q")], "video string, index int, question string")
    asked = E.pack_questions(df)
    hot = asked.where("video = 'hot'").orderBy("position").collect()
    assert [(r["position"], r["index"]) for r in hot] == [(i, i * 7) for i in range(1001)]
    packs = E.pack_maps(asked, ["video"], F.floor(F.col("position") / 100)).collect()
    assert sorted(len(p["questions"]) for p in packs if p["video"] == "hot") == [1] + [100] * 10
    assert [p["questions"] for p in packs if p["video"] == "cold"] == [{"1": "q"}]


def brute_best(hay, needle_tokens, needle, joint=" "):
    best, where = 0.0, -1
    k = len(needle_tokens)
    for i in range(len(hay) - k + 1 if k else 0):
        window = hay[i : i + k]
        if set(window) & set(needle_tokens):
            ratio = SequenceMatcher(None, joint.join(window), needle).ratio()
            if ratio > best:
                best, where = ratio, i
    return best, where


@pytest.mark.parametrize("joint", [" ", ""])
def test_best_window_equals_exhaustive_search(joint):
    """Blanks on both sides of 200 characters, altered, cut short and strange ones, in replies with copies of themselves."""
    rng = random.Random(11)
    syllables = ["th", "in", "er", "on", "re", "qu", "x", "zo", "he", "an", "é"]
    for _ in range(150):
        vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.choice([5, 30, 200]))] + [".", ","]
        hay = [rng.choice(vocabulary) for _ in range(rng.randint(0, 140))]
        k = rng.choice([1, 2, 3, 8, 20, 60, 100])
        start = rng.randrange(len(hay) + 1)
        need = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in hay[start:start + k]] or rng.choices(vocabulary, k=k)
        needle = rng.choice([joint.join(need), " ".join(need) + "?"])
        assert CV.Reply(hay, joint).best(need, needle) == brute_best(hay, need, needle, joint)


def test_blocks_of_long_texts_equal_the_matcher():
    """Long starts, too: characters that are all rare, and copies with some of them changed."""
    rng = random.Random(12)
    for kinds in (4, 30, 400, 5000):
        for _ in range(12):
            needle = "".join(chr(200 + rng.randrange(kinds)) for _ in range(rng.randint(200, 700)))
            text = list(needle * 2)
            for _ in range(rng.randint(0, 60)):
                text[rng.randrange(len(text))] = chr(200 + rng.randrange(kinds))
            reply = CV.Reply(text, "")
            seeds = CV.Seeds(reply.text, CV.np.frombuffer(needle.encode("utf-32-le"), CV.np.uint32), reply.places)
            for _ in range(6):
                begin = rng.randrange(len(text) - 10)
                end = rng.randint(begin + 1, len(text))
                matched = sum(b.size for b in SequenceMatcher(None, reply.whole[begin:end], needle).get_matching_blocks())
                assert seeds.matched(begin, end, 0) == matched and seeds.matched(begin, end, matched) == matched
                ends = CV.np.array([begin]), CV.np.array([end])
                assert seeds.bound(*ends)[0] >= matched


def test_blocks_of_short_texts_equal_the_matcher():
    """Starts of a short blank are found once for all windows; runs over and under the length that is taken part by part."""
    rng = random.Random(13)
    for kinds in (2, 5, 30, 400):
        for _ in range(25):
            needle = "".join(chr(97 + rng.randrange(kinds)) for _ in range(rng.randint(1, 199)))
            text = list(needle * 3)
            for _ in range(rng.randint(0, 60)):
                text[rng.randrange(len(text))] = chr(97 + rng.randrange(kinds))
            reply = CV.Reply(text, "")
            begins = CV.np.array([rng.randrange(len(text)) for _ in range(8)])
            ends = CV.np.array([rng.randint(b + 1, len(text)) for b in begins.tolist()])
            seeds = CV.Seeds.within(reply.text, CV.np.frombuffer(needle.encode("utf-32-le"), CV.np.uint32), begins, ends, reply.whole, needle)
            for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                matched = sum(b.size for b in SequenceMatcher(None, reply.whole[begin:end], needle).get_matching_blocks())
                assert seeds.matched(begin, end, 0) == matched and seeds.matched(begin, end, matched) == matched
                assert seeds.matched(begin, end, matched + 1) in (matched, -1)


def test_common_subsequences_of_many_windows():
    rng = random.Random(13)
    text = CV.np.array([rng.randrange(6) for _ in range(400)], dtype=CV.np.uint32)
    for size in (1, 5, 63, 64, 65, 128, 150, 199):
        needle = CV.np.array([rng.randrange(7) for _ in range(size)], dtype=CV.np.uint32)
        begins = CV.np.array([rng.randrange(380) for _ in range(60)])
        ends = CV.np.array([rng.randint(b, 400) for b in begins.tolist()])
        many = CV.common_subsequences(text, begins, ends, needle).tolist()
        assert many == [lcs(text[b:e].tolist(), needle.tolist()) for b, e in zip(begins.tolist(), ends.tolist())]


def test_covered_text(spark):
    df = spark.createDataFrame(
        [(1, "x Assistant: the quick brown fox jumps", ["quick brown", "lazy dog"]), (2, "Sorry, no", ["quick"]), (3, "quick", ["quick brown fox"])],
        "idx int, prediction string, answers array<string>",
    )
    got = {(r["idx"], r["blank"]): r for r in CV.covered_text(df).collect()}
    assert got[(1, 0)]["exact_match"] == 1.0 and got[(1, 0)]["jaccard"] == 1.0 and got[(1, 0)]["rouge1"] == 1.0
    assert got[(1, 1)]["max_sim_string"] == "" and got[(1, 1)]["f1"] == 0.0
    assert got[(2, 0)]["max_sim_val"] == 0.0 and got[(3, 0)]["max_sim_val"] == 0.0 and len(got) == 4


def test_covered_lines_equal_exhaustive_search(spark):
    """Lines of real documents with changed words, every window of every line aligned."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) < 900][:25]
    rows = []
    for i, text in enumerate(docs):
        other = docs[i - 1].split() or ["?"]
        lines = [x.strip().split(" ") for x in text.split("\n") if x.strip()]
        rows.append((i, text, [" ".join(other[n % len(other)] if n % 5 == min(4, len(ws) - 1) else w for n, w in enumerate(ws)) for ws in lines]))
    df = spark.createDataFrame(rows, "idx int, prediction string, answers array<string>")
    got = {(r.idx, r.blank): r for r in CV.covered_text(df).collect()}
    tokens = {r.x: r.t for r in spark.createDataFrame([(x,) for _, text, lines in rows for x in {text, *lines}], "x string").withColumn("t", CV.tokenise("x")).collect()}
    assert len(got) == sum(len(lines) for _, _, lines in rows)
    for i, text, lines in rows:
        for n, line in enumerate(lines):
            sim, where = brute_best(tokens[text], tokens[line], line)
            window = tokens[text][where:where + len(tokens[line])] if where >= 0 else []
            r = got[i, n]
            assert (r.max_sim_val, r.max_sim_string) == (sim, " ".join(window)), (i, n)
            both = len(set(window) & set(tokens[line]))
            assert r.jaccard == (both / len(set(window) | set(tokens[line])) if window else 0.0)
            assert r.exact_match == float(bool(window) and window == tokens[line])


def test_covered_text_chinese(spark):
    df = spark.createDataFrame([(1, "今天天气很好", ["天气"])], "idx int, prediction string, answers array<string>")
    row = CV.covered_text(df, language="zh").first()
    assert row["max_sim_string"] == "天气" and row["exact_match"] == 1.0


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence(spark):
    """Also references over one, two and three numbers of bits, and carries through all of them."""
    rng = random.Random(2)
    pairs = [[[rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijklmnop") for _ in range(rng.choice([0, 1, 30, 61, 62, 63, 124, 125, 190]))] for _ in range(2)] for _ in range(80)]
    pairs += [[["a"] * 200, ["a"] * 187], [["a", "b"] * 80, ["b", "a"] * 70]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.n for r in df.select("i", CA.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: lcs(a, b) for i, (a, b) in enumerate(pairs)}


def test_rouge_l(spark):
    df = spark.createDataFrame([(1, "a b c d", ["a c", "x y z w"])], "idx int, prediction string, references array<string>")
    p, r, b2 = 2 / 4, 2 / 2, 1.44
    assert CA.rouge_l(df).first()["rouge_l"] == pytest.approx((1 + b2) * p * r / (r + b2 * p))


def test_perfect_captions_by_run(spark):
    """Two models with the same index: one says what the reference says, one nothing of it."""
    texts = [f"word{i} and some more words of text {i}" for i in range(4)]
    rows = [("good", "d", i, t, [t]) for i, t in enumerate(texts)] + [("bad", "d", i, "nothing like it", [t]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "model string, dataset string, idx int, prediction string, references array<string>")
    scores = {r["model"]: r.asDict() for r in AR.captions(df).collect()}
    assert all(scores["good"][f"Bleu_{n}"] == pytest.approx(100.0) for n in (1, 2, 3, 4))
    assert scores["good"]["ROUGE_L"] == pytest.approx(100.0) and scores["good"]["CIDEr"] == pytest.approx(1000.0)
    assert scores["bad"]["ROUGE_L"] == 0.0 and scores["bad"]["CIDEr"] == 0.0 and scores["bad"]["Bleu_1"] < 1e-6


def test_clipping_and_closest_length(spark):
    df = spark.createDataFrame([(1, "the the the cat", ["the cat", "the the dog sat on"])], "idx int, prediction string, references array<string>")
    # 4 words, the closer of 2 and 5 is 5; "the" twice and "cat" once, "the the" and "the cat" once each.
    got = CA.bleu(CA.caption_grams(df)).first()
    penalty = math.exp(1 - 5 / 4)
    assert got["Bleu_1"] == pytest.approx(100 * penalty * 3 / 4) and got["Bleu_2"] == pytest.approx(100 * penalty * math.sqrt(3 / 4 * 2 / 3))


def test_shared_grams_equal_counting(spark):
    """Repeats on both sides, empty texts, no references, references with the same grams; counted by hand."""
    rng = random.Random(21)
    text = lambda: " ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 5, 40])))
    rows = [(i, text(), [text() for _ in range(rng.choice([0, 1, 2, 3]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "idx int, prediction string, references array<string>")
    got = CA.caption_grams(df).select("idx", CA.clipped_matches("hyp", "refs").alias("c"), CA.shared_grams("hyp", "refs").alias("s")).collect()
    grams = lambda t, n: Counter(tuple(t.split()[i:i + n]) for i in range(len(t.split()) - n + 1))
    want = {i: (h, rs) for i, h, rs in rows}
    assert len(got) == len(rows)
    for r in got:
        h, refs = want[r.idx]
        for n in range(1, 5):
            own, theirs = grams(h, n), [grams(t, n) for t in refs]
            assert r.c[n - 1] == sum(min(k, max([t[g] for t in theirs], default=0)) for g, k in own.items())
            for at, t in enumerate(theirs):
                assert sorted((s.own, s.theirs) for s in r.s if s.order == n - 1 and s.text == at) == sorted((own[g], k) for g, k in t.items() if g in own)


def test_equal_blanks_are_searched_once():
    """A reply's equal blanks are one search, and each of them gets its answer; another reply's are searched again."""
    calls, best = [], CV.Reply.best

    def counted(self, needle, text):
        calls.append(text)
        return best(self, needle, text)

    hay = ["a", "b", "c", "d", "a", "b"]
    blanks = ["b c", "x y", "b c", "b  c", "b c"]
    needles = [b.split() for b in blanks]
    columns = [pa.array([x, x]) for x in (hay, needles, blanks, " ")]
    CV.Reply.best = counted
    try:
        first, second = CV._searched(*columns).to_pylist()
    finally:
        CV.Reply.best = best
    assert calls == ["b c", "x y", "b  c"] * 2
    assert first == second and [f["window"] for f in first] == [["b", "c"], None, ["b", "c"], ["b", "c"], ["b", "c"]]
    assert first[0]["sim"] == first[2]["sim"] == first[4]["sim"] == 1.0


def test_captions_write_words_once(spark):
    """What is written has one number per word, not one for each of its grams; grams that no reference has do not leave their row."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = text(20)
    rows = [(i, text(400) + " " + shared, [shared]) for i in range(100)]
    df = spark.createDataFrame(rows, "idx int, prediction string, references array<string>")
    grams = CA.caption_grams(df)
    (path,) = {f.rsplit("/", 1)[0] for f in grams.inputFiles()}
    size = sum(os.path.getsize(os.path.join(path.removeprefix("file://"), f)) for f in os.listdir(path.removeprefix("file://")))
    assert size < 100 * 440 * 8 * 1.5
    marks = CA.marked(spark.createDataFrame([(1,), (-5,), (1 << 40,)], "gram long"))
    texts = spark.createDataFrame([([[1, 1, 2], [-5, 7]], 0), ([], 1), (None, 2), ([[], [1 << 40] * 3], 3)], "g array<array<bigint>>, i int")
    got = {r.i: [tuple(x) for x in r.t] for r in texts.select("i", CA.gram_times("g", marks).alias("t")).collect()}
    assert got == {0: [(0, 1, 2), (1, -5, 1)], 1: [], 2: [], 3: [(1, 1 << 40, 3)]}


def test_cider_of_repeated_keys_and_without_broadcast(spark):
    """CIDEr counted by hand; rows of one key count as one text, and joins that are not broadcast give the same."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 9])), [text(rng.choice([0, 3, 7])) for _ in range(1 + i % 2)]) for i in range(30)]
    rows += [(None, "a b a", ["a b"]), (7, "a a c", rows[7][2])]
    df = spark.createDataFrame(rows, "idx int, prediction string, references array<string>")
    grams = lambda t: Counter((n, tuple(t.split()[i:i + n])) for n in range(1, 5) for i in range(len(t.split()) - n + 1))
    held = Counter(g for _, _, refs in rows for g in {g for r in refs for g in grams(r)})
    log_rows = math.log(len(rows))
    weight = lambda g: log_rows - math.log(max(held[g], 1))
    norm = lambda c, n: math.sqrt(sum((k * weight(g)) ** 2 for g, k in c.items() if g[0] == n))
    want = {}
    for idx, h, refs in (r for r in rows if r[0] != 7):
        own, score = grams(h), 0.0
        for r in refs:
            theirs, total = grams(r), 0.0
            for n in range(1, 5):
                dot = sum(min(own[g], k) * weight(g) * k * weight(g) for g, k in theirs.items() if g[0] == n)
                scale = norm(own, n) * norm(theirs, n)
                total += dot / scale if scale else dot
            gap = max(len(h.split()) - 1, 0) - max(len(r.split()) - 1, 0)
            score += total * math.exp(-gap * gap / 72)
        want[idx] = score / len(refs) / 4 * 10
    found = {}
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = sorted(((r.idx is not None, r.idx, r.cider) for r in CA.cider(CA.caption_grams(df)).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == len(rows) and all(c == pytest.approx(want[i], abs=1e-9) for _, i, c in got if i != 7)
        found[limit] = [round(c, 9) for _, _, c in got]
    assert found["10m"] == found["-1"]


def test_gram_profile(spark):
    df = spark.createDataFrame([(1, "a b a b", ["", "x"]), (2, None, ["a a a"])], "idx int, prediction string, references array<string>")
    got = {(r.ref, r.order): (r.grams, r.total, r.most) for r in CA.gram_profile(CA.caption_grams(df)).collect()}
    words = {k: v for k, v in got.items() if k[1] == 1}
    assert got[-1, 2] == (2, 3, 2) and words[0, 1] == (1, 3, 3) and words[1, 1] == (1, 1, 1) and (1, 2) not in got


def test_denotations(spark):
    rows = [("1|2", "2|1"), ("3", "3.0"), ("Paris", "paris [1]"), ("a|b", "a"), ("2004-xx-xx", "2004"), ("xx-05-06", "xx-5-6"), ("1", "one"), ("a|a", "a"),
            ("“x”", '"x"'), ("café", "cafe")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, prediction string")
    got = [r["score"] for r in SC.score_table_denotation(df).orderBy("i").collect()]
    assert got == [1, 1, 1, 0, 1, 1, 0, 1, 1, 1]


def test_cell_clean_up():
    assert D._normalise('"Hello (x) [3]"') == "hello"
    assert D._normalise("Hello (a) (b)†.") == "hello (a) (b)†"
    assert D._normalise("Tom  Smith (actor)[12]") == "tom smith"
    assert D._normalise("It`s – ok.") == "it's - ok"


def test_financial_tables(spark):
    rows = [("$1,200 million", "1200"), ("1.2 billion", "1200 million"), ("12%", "0.12"), ("5 shares", "5"), ("n/a", "N/A")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, prediction string")
    got = [(r["exact_score"], r["score"]) for r in SC.score_table_financial(df).orderBy("i").collect()]
    assert got == [(0, 1), (1, 1), (1, 1), (1, 1), (1, 1)]


def test_maths_expression(spark):
    rows = [("1/2", "0.5", "[]", 1), ("2**3", "8", "[]", 1), ("x", "X ", "[]", 1), ("1/0", "1", "[]", 0), ("__import__('os')", "1", "[]", 0), ("B", "b", "['p', 'q']", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, res string, answer string, choices string, want int")
    assert all(r["hit"] == r["want"] for r in SC.score_maths_expression(df).collect())


def test_maths_text_answers_never_score_unless_strict(spark):
    df = spark.createDataFrame([("free_form", "text", "cat", "cat", None, None)],
                               "question_type string, answer_type string, answer string, res string, choices string, answer_option string")
    assert SC.score_maths(df).first()["hit"] == 0 and SC.score_maths(df, strict=True).first()["hit"] == 1


def test_single_gold_never_agrees(spark):
    df = spark.createDataFrame([("cat", "cat"), ("['cat', 'cat', 'cat', 'cat']", "the cat")], "answer string, prediction string")
    assert [r["hit"] for r in SC.score_vqa(df, "consensus").collect()] == [0.0, 1.0]


def test_judge_runs_only_where_needed(spark):
    df = spark.createDataFrame([(1, "A", "p1"), (2, None, "p2"), (3, None, "p3")], "index int, opt string, prompt string")

    def judge(prompt, temperature=0.0):
        if prompt == "p1":
            raise AssertionError("settled rows must not be asked")
        if prompt == "p3" and temperature < 1.0:
            raise ValueError("busy")
        return f"{prompt} {temperature}"

    got = rows_of(B.judge_unresolved(df, F.col("opt").isNull(), judge, tries=3).select("index", "reply", "tries"), "index")
    assert got == [(1, None, None), (2, "p2 0.0", 1), (3, "p3 1.0", 3)]


def test_resume_asks_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "index int, prompt string")
    store = B.ResultStore(spark, str(tmp_path / "replies"), B.store_schema(rows, ["index"]), ["index"])

    def flaky(prompt, temperature=0.0):
        return K.FAIL_MESSAGE if prompt.endswith("7") else "ok"

    assert B.run_resumable(rows, flaky, store, chunks=3).count() == 20

    def never(prompt, temperature=0.0):
        raise AssertionError("asked again")

    assert B.run_resumable(rows, never, store).where("reply = 'ok'").count() == 18
    assert B.second_pass(rows, lambda p, temperature=0.0: "late", store).where("reply = 'late'").count() == 2


def test_judge_rounds(spark, tmp_path):
    rows = spark.createDataFrame([(1, "yes"), (2, "later")], "index int, prompt string")
    store = B.ResultStore(spark, str(tmp_path / "rounds"), B.store_schema(rows, ["index"]), ["index"])

    def judge(prompt, temperature=0.0):
        return "7" if prompt == "yes" or temperature >= 0.5 else "no number"

    got = B.judge_rounds(rows, judge, F.expr("try_cast(reply as int)"), store)
    assert rows_of(got.select("index", "parsed", "pass"), "index") == [(1, 7, 0), (2, 7, 1)]


def test_multi_turn_context_and_budget(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * 10) for c in (1, 2) for t in range(6)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    full = rows_of(B.multi_turn(df, lambda stack: str(len(stack))), "conv_id", "turn")
    assert full == [(c, t, str(t + 1)) for c in (1, 2) for t in (0, 2, 4)]
    cut = rows_of(B.multi_turn(df, lambda stack: str(len(stack)), budget=25), "conv_id", "turn")
    assert [r[2] for r in cut] == ["1", "3", "3"] * 2


def test_images(spark):
    payload = "x" * 70
    df = spark.createDataFrame([(1, payload), (2, "1"), (3, "2"), (4, "9")], "index int, image string")
    got = rows_of(PR.resolve_images(df).select("index", "image", "image_error"), "index")
    assert got == [(1, payload, False), (2, payload, False), (3, "2", True), (4, "9", True)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\n\tc, \\d'), (2, "é")], "index int, text string")
    for ending in ("tsv", "csv", "jsonl", "parquet", "orc"):
        path = str(tmp_path / f"t.{ending}")
        TB.write_table(df, path)
        assert rows_of(TB.read_table(spark, path, schema="index int, text string"), "index") == rows_of(df, "index")


def test_headers_index_and_submission(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "Index string, A string")
    assert TB.canonical_headers(df).columns == ["index", "A"]
    assert dict(TB.typed_index(TB.canonical_headers(df)).dtypes)["index"] == "bigint"
    mixed = spark.createDataFrame([("1",), ("x",)], "index string")
    assert dict(TB.typed_index(mixed).dtypes)["index"] == "string"
    assert sorted(r["column"] for r in TB.check_submission(df).collect()) == ["B", "C", "D", "prediction"]


def test_subtitle_files(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\n2\n00:01:00,000 --> 00:01:01,000\nbye\n"
    (tmp_path / "v1.srt").write_text(text)
    (tmp_path / "v2.srt").write_bytes((text + "\nno stamp\n").replace("\n", "\r\n").encode())
    cues = [(1, 1000, 2500, "hello\\Nthere"), (2, 60000, 61000, "bye")]
    assert rows_of(PR.read_subtitles(spark, str(tmp_path)), "video", "pos") == [(v, *c) for v in ("v1", "v2") for c in cues]
    assert rows_of(PR.broken_cues(spark, str(tmp_path)), "video") == [("v2", 1)]


def test_document_pages(spark):
    df = spark.createDataFrame([("d", [f"p{i}" for i in range(300)])], "doc_id string, image_path array<string>")
    pages = E.document_pages(df).collect()
    assert len(pages) == 300 and {r["page_group"] for r in pages} == set(range(15))
    assert E.document_pages(df, max_pages=120).count() == 120
    assert {r["page_group"] for r in E.document_pages(df, groups=1).collect()} == {0}


def test_rotations_of_large_indices_stay_apart(spark):
    rows = [(5, "q", "w", "x", "y", "z", "A"), (1_000_005, "q", "w", "x", "y", "z", "C")]
    table = spark.createDataFrame(rows, "index bigint, question string, A string, B string, C string, D string, answer string")
    offset = C.offset_above(table)
    asked = C.expand_rotations(table, offset=offset)
    answered = asked.withColumns({"prediction": F.col("answer"), "gt": F.col("answer")})
    options = {c: c for c in "ABCD"}
    got = C.score_circular(answered, options, offset=offset).orderBy("index").collect()
    assert [(r["index"], r["hit"], r["n"]) for r in got] == [(5, 1, 4), (1_000_005, 1, 4)]
    flags = C.rotation_flags(answered, offset=offset).orderBy("gid").collect()
    assert [(r["gid"], r["valid"], r["consistent"]) for r in flags] == [(5, True, True), (1_000_005, True, True)]


def test_workers_need_no_path(tmp_path):
    """Queries with Python functions from another folder, with nothing on the path but what the entry module adds."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_module", "{root}/__spark_entry__.py")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from evalspark import session
spark = session.builder("elsewhere").master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("table_denotation", "pack_answers", "caption_bleu", "math_subject_report"):
    assert module.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
