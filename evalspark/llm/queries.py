"""Queries of the training-text operators over whole tables, and the SQL of those that SQL can express.

Each query gets its rows through its operator and derives the digest columns from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (
    byte_bpe,
    conversations,
    exact_dedup,
    fingerprints,
    language_model,
    mixing,
    near_dedup,
    periodic_runs,
    piece_bpe,
    quality,
    repeats,
    token_counts,
    toxicity,
)
from evalspark.operators.order import join_groups
from evalspark.session import ship

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(spark, folder)

        QUERIES[run.__name__] = shipped
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


def held_out(parts: int, part: int) -> Column:
    """Whether a row is kept out of learning, by its id alone; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labels."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "toxic").filter(~held_out(3, 1))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_terms", "n_edited", "n_quoted",
    )


@query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labels."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "quality").filter(~held_out(5, 0))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages")


@query()
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.taken_words(table(spark, folder, "documents", "doc_id", "text", "source"))


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted once per distinct content."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.load(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query()
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    cut = repeats.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.edit_report(table(spark, folder, "documents", "doc_id", "text"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document, up to white space."""
    return exact_dedup.group_copies(table(spark, folder, "documents", "doc_id", "text"))


@query()
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of every document on sets of two-word shingles."""
    return near_dedup.group_near(table(spark, folder, "documents", "doc_id", "text"), width=2, similarity=80)


@query()
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    vocabulary = byte_bpe.load(spark)
    encoded = byte_bpe.encode(table(spark, folder, "documents", "doc_id", "text"), vocabulary).select("doc_id", "ids")
    decoded = byte_bpe.decode(encoded, vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query()
def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of them."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    scored = language_model.score(docs, ~held_out(7, 2))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts in which a tenth of the documents, by the digest of the id, repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.col("__words")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    split = docs.withColumn("__words", F.when((h % 10 == 0) & has_words, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # n words in all: a as they are, then the next p over and over, the last time cut short.
    times, left = F.floor((n - a) / p).cast("int"), (n - a) % p
    parts = F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.slice(words, a + 1, left))
    return split.withColumn("text", F.when(words.isNull(), F.col("text")).otherwise(F.array_join(parts, " "))).drop("__words")


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeating words of every document, and what is left without them."""
    found = periodic_runs.find_runs(with_planted_runs(table(spark, folder, "documents", "doc_id", "text")))
    runs = F.col("runs")

    def by_exponent(a: Column, b: Column) -> Column:
        """Greatest length / period first, compared exactly; then start, then period."""
        sides = (b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"])
        return F.coalesce(*[F.when(s != 0, F.signum(s).cast("int")) for s in sides], F.lit(0))

    best = F.get(F.array_sort(runs, by_exponent), F.lit(0))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    chosen = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return chosen.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"), F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op12_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by pieces and decoded again."""
    model = piece_bpe.load(spark)
    decoded = piece_bpe.decode(piece_bpe.encode(table(spark, folder, "documents", "doc_id", "text"), model), model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Conversations of which some rows are dropped, emptied, cut short, repeated or given to the user, by the digest of their place."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in rows.columns}
    fault = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    changed = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text["text"], "[.!?]", "")).otherwise(text["text"])
    return rows.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text["role"]).alias("role"), changed.alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


@query()
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    repaired, report = conversations.repair(with_faults(rows))
    known = join_groups(rows.select("conv_id").distinct(), report, ["conv_id"], "left")
    known = join_groups(known, conversations.digests(repaired), ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
