"""Every stage of the pipeline against a brute-force version of its decision, on what its predecessor kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import quality, queries
from evalspark.session import materialise
from test_training_operators import brute_near

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER))
        out.append((name, docs))
    return dict(out)


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mixing", "tokens"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~queries.held_out(5, 0))
    network = quality.learn(stages["documents"], labels)
    want = [r for r in rows(stages["documents"]) if network.score([r[1]])[0][0] >= 0.3]
    assert rows(stages["quality"]) == want


def test_exact_stage(stages):
    seen, want = set(), []
    for key, text in rows(stages["quality"]):
        body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if body not in seen:
            want.append((key, text))
        seen.add(body)
    assert rows(stages["exact"]) == want


def test_near_stage(stages):
    before = rows(stages["exact"])
    classes = brute_near(before, 5)
    assert rows(stages["near"]) == [r for r in before if classes[r[0]][1] == r[0]]


def test_mixing_stage(stages):
    before, after = dict(rows(stages["near"])), dict(rows(stages["mixing"]))
    assert after and after.keys() <= before.keys()
    for key, text in after.items():
        own = before[key].split()
        assert set(text.split()) <= set(own) and len(text.split()) <= 2 * len(own)
    assert stages["mixing"].filter(F.col("n_chars") != F.length("text")).isEmpty()


def test_token_stage(stages):
    assert stages["tokens"].count() == stages["mixing"].count()
    assert stages["tokens"].filter((F.col("decoded") != F.col("text")) | (F.size("ids") != F.col("n_tokens"))).isEmpty()


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages["tokens"])
