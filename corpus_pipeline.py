"""A corpus made ready for training: stages over the columns of ``documents``, each one operator of ``evalspark.llm``.

Every stage takes the rows that its predecessor kept and returns the columns of ``documents``; the last one adds token ids and
what they decode to.

1. quality: documents that the classifier rejects go (score under 0.3); it learns from labels outside the held-out fifth.
2. exact: of equal texts, up to white space, one stays.
3. near: of each group of near duplicates (five-word shingles, similarity 0.8) one stays.
4. mixing: sources are mixed to their target weights; a document's text becomes what the mix takes of it.
5. tokens: every text is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from evalspark.llm.queries import held_out
from evalspark.session import materialise, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(~held_out(5, 0))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.filter("score >= 0.3").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_copies(docs)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near(docs, width=5, similarity=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = byte_bpe.load(spark)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    return decoded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded", F.col("decoded").cast("string"))


STAGES = [
    ("quality", keep_quality),
    ("exact", keep_one_copy),
    ("near", keep_one_near),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]
#: A trained classifier, registers and a tokenizer have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
