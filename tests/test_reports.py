"""Reports on small tables, their invariants, and the registered queries on the smallest scale."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from check import canonical, compare
from evalspark.catalog import REGISTRY
from evalspark.catalog.base import TABLES
from evalspark.functions import messages as M
from evalspark.operators import replies as RP
from evalspark.operators import scorers as SC
from evalspark.plans import answer_reports as AR
from evalspark.plans import choice_reports as R
from evalspark.plans import evaluate as EV
from evalspark.plans import grouping as G
from evalspark.plans import judged_reports as JR
from evalspark.plans import run_matrix as RM
from evalspark.plans import run_reports as RR
from evalspark.sources import ordered as OR

SMALL = "/root/testdata/sf0.001"


def scored(spark, seed=0, n=400):
    rng = random.Random(seed)
    rows = [(i, f"m{rng.randrange(2)}", rng.choice(["dev", "test"]), rng.choice(["x", "y"]), rng.choice("abc"), rng.randrange(2)) for i in range(n)]
    return spark.createDataFrame(rows, "index int, model string, split string, l2_category string, category string, hit int")


def as_dict(df, keys, value="score"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_accuracy_levels_add_up(spark):
    report = R.accuracy(scored(spark), by=("model",)).collect()
    for level in ("l2_category", "category"):
        for m in ("m0", "m1"):
            for s in ("dev", "test"):
                rows = [r for r in report if (r["model"], r["split"]) == (m, s)]
                whole = next(r for r in rows if r["level"] == "overall")
                parts = [r for r in rows if r["level"] == level]
                assert sum(r["n"] for r in parts) == whole["n"]
                assert sum(r["n"] * r["score"] for r in parts) == pytest.approx(whole["n"] * whole["score"])


def test_reports_ignore_row_order_and_partitions(spark):
    df = scored(spark)
    keys = ["model", "split", "level", "key"]
    first = as_dict(R.accuracy(df, by=("model",)), keys)
    assert as_dict(R.accuracy(df.orderBy(F.rand(1)).repartition(7), by=("model",)), keys) == first


def test_short_names_and_wide_form(spark):
    df = spark.createDataFrame([("dev", "logic_reasoning", "logic_reasoning", 1), ("dev", "logic_reasoning", "other", 0)],
                               "split string, l2_category string, category string, hit int")
    report = R.accuracy(df, by=())
    wide = G.to_wide(report, ["split"]).first().asDict()
    assert wide == {"split": "dev", "LR": 1.0, "Overall": 0.5, "other": 0.0}


def test_macro_needs_every_category(spark):
    df = spark.createDataFrame([("dev", "ocr", "a", 1), ("dev", "ocr", "b", 0), ("test", "ocr", "a", 1)], "split string, l2_category string, category string, hit int")
    report = as_dict(R.macro_accuracy(df, by=()), ["split", "key"])
    assert report[("dev", "OCR")] == 0.5 and report[("test", "OCR")] is None and report[("ALL", "OCR")] == 0.5


def test_cycle_average_divides_by_all_cycles(spark):
    df = spark.createDataFrame([("m", "c0", "a", 1), ("m", "c1", "b", 1), ("m", "c1", "b", 0)], "model string, cycle_category string, category string, hit int")
    report = as_dict(R.cycle_accuracy(df, by=("model",)), ["cycle", "type"])
    assert report[("Average", "a")] == 0.5 and report[("Average", "b")] == 0.25 and report[("Average", "all")] == 0.75


def test_pairs(spark):
    rows = [("OCR", "i1", 0, 1), ("OCR", "i1", 1, 1), ("OCR", "i2", 2, 1), ("OCR", "i2", 3, 0), ("OCR", "i3", 4, 1), ("color", "i1", 5, 1)]
    df = spark.createDataFrame(rows, "category string, image_path string, index int, score int")
    report = {r["key"]: r for r in R.paired(df, by=()).collect()}
    assert report["OCR"]["score"] == pytest.approx(80 + 50) and report["OCR"]["n_unpaired"] == 1
    assert report["color"]["score"] == 100 and report["perception"]["score"] == pytest.approx(230)


def test_f1_counts_listed_categories(spark):
    df = spark.createDataFrame([("a,b", "Yes", "Yes", 1), ("a", "No", "Yes", 0), (None, "Yes", "No", 0)], "category string, answer string, extracted string, score int")
    report = {r["key"]: r for r in R.f1_scores(df, by=()).collect()}
    assert report["Overall"]["n"] == 4 and report["Overall"]["precision"] == pytest.approx(200 / 3) and report["Overall"]["recall"] == pytest.approx(200 / 3)
    assert report["b"]["f1"] == 100 and report["a"]["n"] == 2 and set(report) == {"Overall", "a", "b"}


def test_nested_report_fills_empty_cells(spark):
    df = spark.createDataFrame([("Perception/Monitoring", "X/Attribute/1", 1), ("Perception/Monitoring", "Y", 0), ("Perception/Monitoring", "Y", -1)],
                               "category string, l2_category string, score int")
    report = as_dict(R.nested_accuracy(df, by=()), ["level", "task", "subtask", "path"])
    assert report[("category", "Perception", "Monitoring", "x/attribute")] == 1.0 and report[("overall", None, None, None)] == 0.5
    assert report[("subtask", "Reasoning", "Remote Sensing", None)] == 0.0 and report[("task", "Reasoning", None, None)] == 0.0
    assert len(report) == 2 + 10 + 2 + 1


def test_skill_names_share_one_space(spark):
    df = spark.createDataFrame([(0, "algebra", "['algebra']", "Prefetch succeed", 1)], "pos int, task string, skills string, log string, hit int")
    report = {r["key"]: r for r in AR.task_skill(df, by=(), pos="pos").collect()}
    assert report["algebra"]["tot"] == 2 and report["Overall"]["tot"] == 1 and report["Overall"]["first_place"] == 0


def test_document_f1(spark):
    df = spark.createDataFrame([("a", "a", 1.0), ("Not answerable", "b", 0.0), ("c", "Not answerable", 0.0)], "answer string, pred string, score double")
    df = df.withColumns({"evidence_sources": F.lit("['Chart']"), "evidence_pages": F.lit("[]")})
    report = {r["category"]: r for r in AR.documents(df, by=()).collect()}
    assert report["overall_f1"]["avg_score"] == pytest.approx(0.5) and report["chart"]["num"] == 3 and report["text"]["avg_score"] == 0.0
    assert report["unanswerable"]["num"] == 3


def test_multi_label_counts_rows_once_per_group(spark):
    df = spark.createDataFrame([("['OCR', 'Counting']", 3), ("['OCR']", -1)], "dimensions string, score int")
    report = {(r["level"], r["key"]): r for r in JR.multi_label(df, by=()).collect()}
    assert report[("coarse", "FP-S")]["n"] == 2 and report[("coarse", "FP-S")]["all_score"] == 1.5 and report[("coarse", "FP-S")]["valid_score"] == 3.0
    assert report[("fine", "Counting")]["n"] == 1 and ("coarse", "RR") not in report


def test_task_board_failures(spark):
    df = spark.createDataFrame([("t", -1), ("t", 0), ("t", 1)], "task_type string, score int")
    assert as_dict(JR.task_board(df, by=()), ["key"], "hits")[("t",)] == 2
    assert as_dict(JR.task_board(df, by=(), strict=True), ["key"], "hits")[("t",)] == 1


def test_duration_cube_has_empty_cells(spark):
    df = spark.createDataFrame([("m", "short", "Knowledge", "Law", "OCR Problems", 1)], "model string, duration string, domain string, sub_category string, task_type string, score int")
    cube = as_dict(JR.duration_cube(df, by=("model",), fill=True), ["duration", "level", "key"])
    assert cube[("short", "domain", "Knowledge")] == 1.0 and cube[("long", "domain", "Knowledge")] is None and len(cube) == 4 * (1 + 6 + 30 + 12)


def test_leaderboard(spark):
    reports = spark.createDataFrame([("m1", "A", "dev", "Overall", 0.5), ("m1", "B", None, "perception", 3.0), ("m1", "B", None, "reasoning", 4.0)],
                                    "model string, dataset string, split string, key string, score double")
    metrics = [RR.Metric("a", "A", split="dev", scale=100.0), RR.Metric("b", "B", "perception"), RR.Metric("b", "B", "reasoning"), RR.Metric("c", "C")]
    assert RR.leaderboard(reports, metrics).first().asDict() == {"model": "m1", "a": 50.0, "b": 7.0, "c": None}


def test_missing_matrix_lists_priorities(spark):
    rows = REGISTRY["missing_matrix"](spark, SMALL).select("dataset").distinct().collect()
    assert {r.dataset for r in rows} <= {"1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "RUSH"}


def test_specs_score_prompt_and_report(spark):
    rows = [("m", "d", 1, "What?", "red", "blue", "A", "Answer: B or Answer: A", "c", "x.jpg")]
    df = spark.createDataFrame(rows, "model string, dataset string, index bigint, question string, A string, B string, answer string, prediction string, category string, image_path string")
    report = as_dict(EV.evaluate(df, "choice_tagged"), ["model", "dataset", "split", "level", "key"])
    assert report == {("m", "d", "none", "overall", "Overall"): 1.0, ("m", "d", "none", "category", "c"): 1.0}
    message = EV.prompts(df, "choice").first()["message"]
    assert [p["type"] for p in message] == ["image", "text"] and message[1]["value"].startswith("Question: What?\nOptions:\nA. red\nB. blue\nPlease")
    own = EV.BenchmarkSpec(lambda d: d.withColumn("hit", F.lit(1)), lambda d: G.level_means(d, EV.RUN, {"overall": None}, "hit"))
    assert EV.evaluate_runs(df, {"d": own}).first()["score"] == 1.0


@pytest.mark.parametrize("family", ["choice", "choice_open", "choice_circular", "yes_no", "yes_no_f1", "vqa_consensus", "vqa_anls", "vqa_relaxed", "ocr", "containment"])
def test_every_text_family_runs(spark, family):
    df = spark.createDataFrame([("m", "d", 1, "q", "red", "blue", "A", "A", "c", "l")],
                               "model string, dataset string, index bigint, question string, A string, B string, answer string, prediction string, category string, l2_category string")
    assert EV.evaluate(df, family).columns == EV.LONG


def test_dialogue_takes_images_in_order(spark):
    df = spark.createDataFrame([(["<ImageHere>a", "b<ImageHere><ImageHere>", "c"], ["x", "y", "z"], ["i1", "i2", "i3"])],
                               "q array<string>, a array<string>, i array<string>")
    turns = df.select(M.dialogue(F.col("q"), F.col("a"), F.col("i")).alias("d")).first()["d"]
    assert [t["role"] for t in turns] == ["user", "assistant"] * 3
    assert [[tuple(p) for p in t["content"]] for t in turns[::2]] == [
        [("image", "i1"), ("text", "a")], [("text", "b"), ("image", "i2"), ("image", "i3")], [("text", "c")]]


def test_pack_text(spark):
    text = spark.range(1).select(M.pack_text(F.create_map(F.lit("1"), F.lit("why?"))).alias("t")).first()["t"]
    assert text == 'Questions: \n{"1":"why?"}\nAnswers: \n'


def test_turn_budget_keeps_whole_exchanges(spark):
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("x" * n).alias("text")) for r, n in (("user", 5), ("assistant", 9), ("user", 3), ("assistant", 2))])
    size = lambda t: F.length(t["text"]).cast("bigint")
    kept = [spark.range(1).select(F.size(M.drop_oldest_turns(turns, size, b)).alias("n")).first()["n"] for b in (19, 18, 5, 4)]
    assert kept == [4, 2, 2, 0]


def test_hot_category_is_combined_before_the_shuffle(spark):
    plan = R.accuracy(scored(spark), by=("model",))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < len(plan) and plan.count("Exchange hashpartitioning(model") == 2


def test_scorers_do_not_shuffle(spark):
    df = spark.createDataFrame([("a", "a", "MMMU")], "answer string, prediction string, category string")
    for frame in (SC.score_vqa(df, "consensus"), SC.score_vqa(df, "anls"), SC.score_ocr(df), SC.score_containment(df), SC.score_yes_no(df)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("name", ["mcq_accuracy_report", "circular_score", "yesno_f1_report", "vqa_anls", "subtitle_interval_join", "caption_bleu",
                                  "leaderboard", "concat_datasets", "prompt_mcq", "stream_score"])
def test_registered_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    q = REGISTRY[name]
    assert compare(canonical(q(spark, SMALL).toPandas()), canonical(con.execute(q.oracle).df())) == "ok"


def test_run_matrix_reads_each_table_once(spark):
    plan = REGISTRY["evaluate_all_runs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    read = [re.sub(r"#\d+L?", "", line[line.index("Relation ["):]) for line in plan.splitlines() if "Relation [" in line]
    assert len(read) >= 4 and len(read) == len(set(read)), read


def test_run_matrix_leaves_unknown_data_sets_out(spark):
    rows = [("m", "known", "Yes", "Yes", "c"), ("m", "known", "No", "Yes", "c"), ("m", "other", "Yes", "Yes", "c"), ("n", "known", None, "No", None)]
    df = spark.createDataFrame(rows, "model string, dataset string, prediction string, answer string, category string")
    kinds = spark.createDataFrame([("known", "yes_no", "Y/N")], "dataset string, family string, kind string")
    got = {(r.model, r.level, r.key): (r.n, r.score, r.judge) for r in RM.evaluate_all(df, kinds).collect()}
    assert got == {("m", "overall", "Overall"): (2, 50.0, "chatgpt-0125"), ("m", "category", "c"): (2, 50.0, "chatgpt-0125"), ("n", "overall", "Overall"): (1, 0.0, "chatgpt-0125")}


def test_run_matrix_scores_rows_by_their_own_family_only(spark):
    def strict(df):
        return df.withColumn("hit", F.when(F.col("prediction").isNull(), F.raise_error(F.lit("a row of another family was scored")).cast("double")).otherwise(F.length("prediction")))

    families = {"strict": RM.Family(strict), "yes_no": RM.FAMILIES["yes_no"]}
    df = spark.createDataFrame([("m", "a", "four", None, "c"), ("m", "b", "Yes", "Yes", "c")], "model string, dataset string, prediction string, answer string, category string")
    kinds = spark.createDataFrame([("a", "strict", "VQA"), ("b", "yes_no", "Y/N")], "dataset string, family string, kind string")
    got = {(r.dataset, r.level): (r.n, r.score) for r in RM.evaluate_all(df, kinds, families).collect()}
    assert got == {("a", "overall"): (1, 4.0), ("a", "category"): (1, 4.0), ("b", "overall"): (1, 100.0), ("b", "category"): (1, 100.0)}


def test_order_is_proved_by_the_manifest(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(300), f"t{i}") for i in range(2000)] + [(None, "none")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(5)
    files = OR.write_ordered(df, f"{tmp_path}/t", ["k", "text"], files=6).collect()
    assert len(files) > 1 and all(f.in_order for f in files) and sum(f.n for f in files) == len(rows)
    got = OR.read_ordered(spark, f"{tmp_path}/t").orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(len(rows)))
    assert [(r.k, r.text) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    # A manifest of files that overlap is refused.
    df.repartition(3).sortWithinPartitions("k").write.parquet(f"{tmp_path}/u")
    back = spark.read.parquet(f"{tmp_path}/u").select(F.col("_metadata.file_name").alias("file"), F.struct("k").alias("k"))
    back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.max("k").alias("greatest")).write.parquet(OR.manifest_path(f"{tmp_path}/u"))
    with pytest.raises(ValueError):
        OR.read_ordered(spark, f"{tmp_path}/u")


def test_dialogues_by_turn(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x"], ["p", "q"]), (2, [], ["x"], ["p"])], "idx int, question array<string>, answer array<string>, prediction array<string>")
    got = RP.explode_dialogues(df, ["idx"]).orderBy("turn").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", "x", "p"), (1, 1, "b", None, "q"), (1, 2, "c", None, None)]
    asked = RP.dialogue_requests(RP.explode_dialogues(df, ["idx"]), ["idx"])
    assert asked.count() == 3 and asked.where(~F.contains("prompt", F.lit("Question: "))).isEmpty()


def test_covered_text_report_takes_every_line(spark):
    """All lines are blanks, long ones too, and all of them are changed; few are still found word for word."""
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    got = REGISTRY["covered_text_report"](spark, SMALL).first()
    assert got.n == sum(line.strip() != "" for text in texts for line in (text or "").split("\n"))
    assert 0 < got.Exact_Match < 1 and 0 < got.Jaccard < 1
