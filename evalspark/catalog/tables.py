"""Queries on reading, checking and joining of tables, and the digests of all judge texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark import schema, session
from evalspark.catalog import fixtures as FX
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import answers as A
from evalspark.functions import prompts as P
from evalspark.operators import expand as E
from evalspark.operators import keys as OK
from evalspark.operators import scorers as SC
from evalspark.sources import preparation as PR
from evalspark.sources import tables as TB


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def parquet_to_tsv(src: Source) -> DataFrame:
    """A Parquet table turned into delimited text, and that read back by type."""
    path = session.new_table_path(src.spark, "orders") + ".tsv"
    orders = src.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    source = session.new_table_path(src.spark, "orders")
    orders.write.parquet(source)
    TB.parquet_to_tsv(src.spark, source, path)
    back = TB.read_table(src.spark, path, schema=orders.schema)
    return back.select(*orders.columns)


@query("""SELECT o_orderkey AS "index", o_orderstatus AS A, o_orderpriority AS question, CAST(o_custkey AS VARCHAR) AS image FROM orders WHERE o_orderkey % 5 <> 0""")
def canonical_table(src: Source) -> DataFrame:
    """Headers in their usual spelling, the index by its type, and rows without an image left out."""
    raw = src.table("orders").select(
        F.col("o_orderkey").cast("string").alias("Index"), F.col("o_orderstatus").alias("A"), F.col("o_orderpriority").alias("QUESTION"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("Image"),
    )
    return TB.with_images(TB.typed_index(TB.canonical_headers(raw)))


@query("""SELECT 'x' || p_partkey AS "index", p_brand AS question FROM part""")
def text_index(src: Source) -> DataFrame:
    """An index that is not all whole numbers stays text."""
    parts = src.table("part").select(F.concat(F.lit("x"), "p_partkey").alias("Index"), F.col("p_brand").alias("Question"))
    return TB.typed_index(TB.canonical_headers(parts))


@query(with_view(FX.MCQ, """ SELECT kind, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total FROM (SELECT unnest(['MCQ', 'TEXT_MCQ', 'VQA']) AS kind, idx FROM fx) GROUP BY ALL"""))
def custom_table_kinds(src: Source) -> DataFrame:
    """Task of tables by their columns: with options and an image, with options, with a question alone."""
    rows = src.view(FX.MCQ)
    tables = [rows.withColumn("image_path", F.col("model")), rows, rows.select("idx", "question", "answer")]
    kinds = [t.select(F.lit(schema.table_kind(t.columns)).alias("kind"), "idx") for t in tables]
    merged = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"))


@query(with_view(FX.MCQ, """ SELECT c AS "column", 'the table should have a column named `' || c || '`' AS message, (SELECT count(*) FROM fx) AS n FROM (SELECT unnest(['index', 'D']) AS c)"""))
def submission_check(src: Source) -> DataFrame:
    """Columns that a submission lacks, and how many predictions cannot be handed in for that."""
    rows = src.view(FX.MCQ).select("idx", F.col("prediction").alias("Prediction"), "A", "B", "C")
    return TB.check_submission(rows).withColumn("n", rows.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(with_view(FX.IMAGES, """ SELECT idx, idx || '.jpg' AS own, CASE WHEN idx % 3 = 0 THEN idx || '.png' ELSE idx || '.png,' || (idx + 1) || '.png' END AS listed FROM fx"""))
def image_sources(src: Source) -> DataFrame:
    """Where prompts take images from: rows with a payload by their index, others by the paths they name."""
    rows = src.view(FX.IMAGES)
    own = rows.withColumn("index", F.col("idx"))
    named = rows.select("idx", F.when(F.col("idx") % 3 == 0, F.concat("idx", F.lit(".png"))).otherwise(
        F.concat(F.lit('["'), "idx", F.lit('.png", "'), F.col("idx") + 1, F.lit('.png"]'))).alias("image_path"))
    first = own.select("idx", F.array_join(TB.image_source(own), ",").alias("own"))
    return first.join(named.select("idx", F.array_join(TB.image_source(named), ",").alias("listed")), "idx")


@query(with_view(FX.MCQ, """, r AS (SELECT idx, model, 'done ' || prediction AS reply FROM fx WHERE idx % 4 = 0)
    SELECT fx.idx, fx.model, r.reply FROM fx LEFT JOIN r ON fx.idx = r.idx AND fx.model = r.model"""))
def attached_results(src: Source) -> DataFrame:
    """All rows, with the result of those that have one."""
    rows = src.view(FX.MCQ).select("idx", "model", "prediction")
    results = rows.where("idx % 4 = 0").select("idx", "model", F.concat(F.lit("done "), "prediction").alias("reply"))
    return OK.attach_results(rows.select("idx", "model"), results, ["idx", "model"])


@query(with_view(FX.MCQ, """ SELECT model, count(*) AS n, min(idx) AS first FROM fx WHERE idx % 9 <> 4 GROUP BY model"""))
def known_predictions(src: Source) -> DataFrame:
    """Predictions of questions that the data set has."""
    rows = src.view(FX.MCQ)
    known = OK.known_only(rows, rows.select("idx").where("idx % 9 <> 4"), ["idx"])
    return known.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


def _filled(head: str, *slots: tuple[str, str], end: str = "") -> str:
    """The SQL of a judge text: its head, then named lines."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lines = [f"{quoted(name + ': ')} || coalesce(CAST({value} AS VARCHAR), '') || chr(10)" for name, value in slots]
    return " || ".join([quoted(head), *lines, quoted(end)])


_OPTION_LINES = f"'{K.OPTIONS_HEADER}' || ".replace("\n", "' || chr(10) || '") + " || ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}. ' || {c} || chr(10) ELSE '' END" for c in "ABCD")
_EXPECTED = "replace(replace(answer, '<AND>', ' <AND> '), '<OR>', ' <OR> ')"
_TEXTS = {
    "refusal": _filled(P._OPTION_JUDGE["refusal"], ("Question", "question"), ("Options", f"({_OPTION_LINES})"), ("Reply", "prediction"), end="Letter: "),
    "yes_no": _filled(P._YES_NO_JUDGE, ("Question", "question"), ("Reply", "prediction"), end="Word: "),
    "extraction": _filled(P._EXTRACT_JUDGE, ("Question", "question"), ("Reply", "prediction"), end="Extracted answer: "),
    "open_score": _filled(P._OPEN_SCORE_JUDGE, ("Question", "question"), ("Expected", _EXPECTED), ("Reply", "prediction"), end="Score: "),
    "pair": _filled(P._PAIR_JUDGE, ("Context", "category"), ("Question", "question"), ("Reply 1", "A"), ("Reply 2", "prediction")),
    "dialogue": _filled(P._DIALOGUE_JUDGE, ("Question", "question"), ("Reference", "answer"), ("Reply", "prediction")),
    "video": _filled(P._VIDEO_JUDGE, ("Question", "question"), ("Expected", "answer"), ("Reply", "prediction"), end="Number: "),
    "document": _filled(P._DOCUMENT_JUDGE, ("Question", "question"), ("Analysis", "prediction")),
}


@query(with_view(FX.MCQ, " SELECT model, idx, " + ", ".join(f"md5({sql}) AS {name}" for name, sql in _TEXTS.items()) + " FROM fx"))
def judge_text_digests(src: Source) -> DataFrame:
    """Digest of every text a judge can be asked about a row."""
    texts = {
        "refusal": P.option_judge("question", A.option_map({c: c for c in "ABCD"}), "prediction", refusal=True), "yes_no": P.yes_no_judge("question", "prediction"),
        "extraction": P.extraction_judge("question", "prediction"), "open_score": P.open_score_judge("question", "answer", "prediction"),
        "pair": P.pair_judge("category", "question", "A", "prediction"), "dialogue": P.dialogue_judge("question", "answer", "prediction"),
        "video": P.video_judge("question", "answer", "prediction"), "document": P.document_judge("question", "prediction"),
    }
    return src.view(FX.MCQ).select("model", "idx", *[F.md5(v.cast("binary")).alias(k) for k, v in texts.items()])


@query("""SELECT o_orderkey AS "index", o_custkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey - 1 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END || '.jpg' AS image_path FROM orders""")
def image_paths(src: Source) -> DataFrame:
    """The file of each row's image in place of its payload: its own, or that of the row its cell names."""
    cell = F.when(F.col("o_orderkey") % 3 == 1, (F.col("o_orderkey") - 1).cast("string")).otherwise(F.repeat(F.lit("x"), F.lit(70)))
    return PR.localise_paths(src.table("orders").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("k"), cell.alias("image")))


@query("""SELECT c_custkey, CAST(i AS INT) AS place, 'b' || (c_custkey % 5 + i) AS item FROM customer, LATERAL (SELECT unnest(range(0, 1 + c_custkey % 3)) AS i)""")
def exploded_lists(src: Source) -> DataFrame:
    """Items of comma lists with their places."""
    key = F.col("c_custkey")
    items = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), key % 3), lambda i: F.concat(F.lit("b"), key % 5 + i)), ",")
    return E.explode_list(src.table("customer").select("c_custkey", items.alias("items")), "items", "item", "place").drop("items")


@query("""SELECT e.event_type AS task_type, CASE e.event_type WHEN 'click' THEN NULL ELSE 'files/' || e.event_type END AS prefix, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total
    FROM events e GROUP BY ALL""")
def task_map(src: Source) -> DataFrame:
    """Items of a ``task -> list`` document beside the path prefix of their task; a task without one has none."""
    item = F.struct(F.col("user_id").cast("string").alias("video"), F.col("event_type").alias("question"), F.col("user_id").alias("answer"), F.array("event_type").alias("candidates"))
    # One document per user and type, as such a file holds a part of the items.
    documents = src.table("events").groupBy("user_id", "event_type").agg(F.collect_list(item).alias("items"))
    root = F.when(F.col("event_type") != "click", F.create_map("event_type", F.concat(F.lit("files/"), "event_type"))).otherwise(F.create_map(F.lit("none"), F.lit("files")))
    rows = PR.task_map_table(documents.select(root.alias("root"), F.create_map("event_type", "items").alias("meta")))
    return rows.groupBy("task_type", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("answer").cast("bigint")).alias("total"))


@query(with_view(FX.MCQ, """, v AS (SELECT *, CASE idx % 3 WHEN 0 THEN 8 ELSE 16 END || 'frame_' || CASE WHEN idx % 2 = 0 THEN 'pack' ELSE 'nopack' END || '_' || CASE WHEN idx % 5 = 0 THEN 'subs' ELSE 'nosubs' END AS variant FROM fx)
    SELECT model, variant, count(*) AS n, min(idx) AS first FROM v GROUP BY ALL"""))
def run_variants(src: Source) -> DataFrame:
    """Results written to one folder per model, data set and variant of a video run, and read back by it."""
    rows = src.view(FX.MCQ).select("model", "idx", "prediction", F.lit("video").alias("dataset"))
    variant = TB.run_variant(F.when(F.col("idx") % 3 == 0, 8).otherwise(16), F.col("idx") % 2 == 0, F.col("idx") % 5 == 0)
    path = session.new_table_path(src.spark, "variants")
    TB.write_results(rows.withColumn("variant", variant), path)
    return src.spark.read.parquet(path).groupBy("model", "variant").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


@query(with_view(FX.JUDGED, f""" SELECT idx, '{",".join(d for d in K.DIALOGUE_DIMENSIONS if d not in ("Creativity", "Richness"))}' AS missing FROM fx"""))
def missing_dimensions(src: Source) -> DataFrame:
    """Dimensions that a judge's reply leaves out."""
    scored = SC.score_judged_dimensions(src.view(FX.JUDGED), "dims_reply")
    return scored.select("idx", F.array_join(SC.missing_dimensions(F.col("dims")), ",").alias("missing"))
