"""Queries on table preparation: images, payloads, combined sets, JSON sources, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schema, session
from evalspark.catalog import fixtures as FX
from evalspark.catalog.base import Source, query, with_view
from evalspark.functions import text as T
from evalspark.operators import keys as OK
from evalspark.sources import ordered as OR
from evalspark.sources import preparation as PR
from evalspark.sources import tables as TB


@query(with_view(FX.IMAGES, """, p AS (SELECT CAST(idx AS VARCHAR) AS k, image AS payload FROM fx WHERE length(image) > 64)
    SELECT fx.idx, CASE WHEN length(fx.image) > 64 THEN fx.image ELSE coalesce(p.payload, fx.image) END AS image,
      length(fx.image) <= 64 AND p.k IS NULL AS image_error, CASE WHEN length(fx.image) > 64 THEN CAST(fx.idx AS VARCHAR) ELSE fx.image END AS owner
    FROM fx LEFT JOIN p ON fx.image = p.k"""))
def image_ref_resolve(src: Source) -> DataFrame:
    rows = src.view(FX.IMAGES).withColumn("owner", PR.image_key("idx", "image"))
    return PR.resolve_images(rows, index="idx").select("idx", "image", "image_error", "owner")


@query("""
    WITH d AS (SELECT doc_id, lang, text, page_id, html FROM documents LEFT JOIN (SELECT row_number() OVER (ORDER BY page_id) - 1 AS k, page_id, html FROM pages) ON doc_id = k)
    SELECT lang AS dataset, CASE WHEN doc_id % 2 = 0 OR html IS NULL THEN 'img/' || doc_id || '.png' ELSE 'img/' || doc_id || '_0.png' END AS path,
      CASE WHEN length(to_base64(encode(text))) > 64 THEN md5(text) END AS digest, length(to_base64(encode(text))) <= 64 AS payload_error FROM d
    UNION ALL SELECT lang, 'img/' || doc_id || '_1.png', CASE WHEN length(to_base64(encode(html))) > 64 THEN md5(html) END, length(to_base64(encode(html))) <= 64
      FROM d WHERE doc_id % 2 = 1 AND html IS NOT NULL""")
def image_payloads(src: Source) -> DataFrame:
    """Base64 cells (one or two images) as binary rows by path."""
    first = src.table("pages").agg(F.min("page_id")).scalar()
    pages = src.table("pages").select((F.col("page_id") - first).alias("doc_id"), F.base64(F.col("html").cast("binary")).alias("second"))
    docs = src.table("documents").join(pages, "doc_id", "left")
    one = F.base64(F.col("text").cast("binary"))
    cell = F.when((F.col("doc_id") % 2 == 0) | F.col("second").isNull(), one).otherwise(F.to_json(F.array(one, "second")))
    table = docs.select(
        F.col("lang").alias("dataset"), F.regexp_replace(cell, "[\\r\\n]", "").alias("image"),
        F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"),
    )
    return PR.payload_table(table).select("dataset", "path", F.md5("content").alias("digest"), "payload_error")


@query("""
    WITH a AS (SELECT 0 AS place, 'part' AS sub_dataset, p_partkey AS original_index, p_name AS question, p_brand AS category, NULL AS answer FROM part
      UNION ALL SELECT 1, 'orders', o_orderkey, o_orderpriority, NULL, o_orderstatus FROM orders
      UNION ALL SELECT 2, 'customer', c_custkey, c_name, c_mktsegment, NULL FROM customer)
    SELECT row_number() OVER (ORDER BY place, original_index) - 1 AS index, sub_dataset, original_index, question, category, answer FROM a""")
def concat_datasets(src: Source) -> DataFrame:
    """Three tables as one data set with new row numbers."""
    part = src.table("part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), F.col("p_brand").alias("category"))
    orders = src.table("orders").select(
        F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer")
    )
    customer = src.table("customer").select(
        F.col("c_custkey").alias("index"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("category")
    )
    merged = PR.concat_datasets({"part": part, "orders": orders, "customer": customer})
    return merged.select("index", "sub_dataset", "original_index", "question", "category", "answer")


@query("""
    WITH i AS (SELECT event_id AS index, event_type AS category, '(A) ' || event_type AS a, '(B) ' || CAST(user_id AS VARCHAR) AS b, '(C) x' AS c, '(D) y' AS d, '(E) none' AS e FROM events)
    SELECT index, category, 'The choices are listed below:' || chr(10) || a || chr(10) || b || chr(10) || c || chr(10) || d || chr(10) || e AS options,
      substr(a, 5) AS A, substr(b, 5) AS B, substr(c, 5) AS C, substr(d, 5) AS D, substr(e, 5) AS E FROM i""")
def json_options_etl(src: Source) -> DataFrame:
    from evalspark.constants import REAL_WORLD_CHOICES

    events = src.table("events")
    options = F.array(
        F.concat(F.lit("(A) "), "event_type"), F.concat(F.lit("(B) "), F.col("user_id").cast("string")), F.lit("(C) x"), F.lit("(D) y"), F.lit("(E) none")
    )
    items = events.select(F.col("event_id").alias("index"), F.col("event_type").alias("category"), options.alias("multi-choice options"))
    return PR.options_table(items, REAL_WORLD_CHOICES["en"]).withColumnRenamed("multi-choice options", "options")


@query("""
    SELECT event_id AS index, 'v' || CAST(user_id AS VARCHAR) AS video, './video/v' || CAST(user_id AS VARCHAR) || '.mp4' AS video_path, 'short' AS duration,
      event_type AS domain, 'sub' AS sub_category, 'task' AS task_type, './subtitle/v' || CAST(user_id AS VARCHAR) || '.srt' AS subtitle_path,
      'Which?' || chr(10) || 'A. ' || event_type || chr(10) || 'B. other' AS question, 'A' AS answer FROM events""")
def options_into_question(src: Source) -> DataFrame:
    items = src.table("events").select(
        F.col("event_id").alias("index"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("videoID"), F.lit("short").alias("duration"),
        F.col("event_type").alias("domain"), F.lit("sub").alias("sub_category"), F.lit("task").alias("task_type"), F.lit("Which?").alias("question"),
        F.array(F.concat(F.lit("A. "), "event_type"), F.lit("B. other")).alias("options"), F.lit("A").alias("answer"),
    )
    return PR.options_into_question(items)


_LABELS = """CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'Stage 2' WHEN 2 THEN 'Both' ELSE 'C and D' END"""


@query(f"""
    WITH d AS (SELECT p_partkey, p_brand, 'q ' || p_name AS q0, 'Which letter K is it' AS q1, {_LABELS} AS l FROM part),
    e AS (SELECT *, 0 AS sub, q0 AS question, [l, 'B', p_brand, l] AS o, 2 AS ca, p_partkey % 3 <> 0 AS flag FROM d
      UNION ALL SELECT *, 1, q1, [p_brand, q0, 'x y', 'long text'], p_partkey % 4, p_partkey % 3 <> 0 FROM d)
    SELECT p_partkey * 100 + sub AS index, question, o[1] AS A, o[2] AS B, o[3] AS C, o[4] AS D, substr('ABCD', CAST(ca AS INT) + 1, 1) AS answer, p_brand AS category,
      CASE WHEN flag THEN 'images_abc/' ELSE 'images/' END || CAST(p_partkey AS VARCHAR) || '.png' AS image_path FROM e
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def diagram_etl(src: Source) -> DataFrame:
    """Diagram documents built from parts; only parts that were sold are in the test set."""
    part = src.table("part")
    label = F.when(F.col("p_partkey") % 4 == 0, "A").when(F.col("p_partkey") % 4 == 1, "Stage 2").when(F.col("p_partkey") % 4 == 2, "Both").otherwise("C and D")
    q0, brand, key = F.concat(F.lit("q "), "p_name"), F.col("p_brand"), F.col("p_partkey").cast("string")
    flag = F.col("p_partkey") % 3 != 0

    def meta(sub: int, options: list[Column], correct: Column) -> Column:
        return F.struct(
            F.concat(key, F.lit(f".png-{sub}")).alias("questionId"), F.array(*options).alias("answerTexts"),
            correct.cast("int").alias("correctAnswer"), flag.alias("abcLabel"),
        )

    questions = F.create_map(
        q0, meta(0, [label, F.lit("B"), brand, label], F.lit(2)),
        F.lit("Which letter K is it"), meta(1, [brand, q0, F.lit("x y"), F.lit("long text")], F.col("p_partkey") % 4),
    )
    documents = part.select(F.concat(key, F.lit(".png")).alias("imageName"), questions.alias("questions"))
    categories = part.select(F.concat(key, F.lit(".png")).alias("imageName"), brand.alias("category"))
    test_ids = src.table("lineitem").select(F.col("l_partkey").cast("string").alias("image_id")).distinct()
    return PR.diagram_questions(documents, categories, test_ids).drop("abcLabel")


@query("""
    WITH a AS (SELECT 0 AS place, 'Ship' AS task_type, 'ship/' AS prefix, 'video' AS data_type, true AS bound, 1.5::DOUBLE AS start, o_totalprice AS "end",
        CAST(o_custkey AS VARCHAR) AS video, o_orderpriority AS question, o_orderstatus AS answer, o_orderkey AS pos FROM orders
      UNION ALL SELECT 1, 'Part', 'part/', 'frame', false, NULL, NULL, CAST(p_partkey AS VARCHAR), p_name, p_brand, p_partkey FROM part)
    SELECT row_number() OVER (ORDER BY place, pos) - 1 AS index, task_type, prefix, data_type, bound, coalesce(start, -1.0) AS start, coalesce("end", -1.0) AS "end", video, question, answer
    FROM a""")
def task_union_etl(src: Source) -> DataFrame:
    """Two task files as one table; one of them has time bounds."""
    orders = src.table("orders").select(
        F.lit(1.5).alias("start"), F.col("o_totalprice").alias("end"), F.col("o_custkey").cast("string").alias("video"), F.col("o_orderpriority").alias("question"),
        F.col("o_orderstatus").alias("answer"), F.array("o_orderstatus").alias("candidates"), F.col("o_orderkey").alias("pos"),
    )
    part = src.table("part").select(
        F.col("p_partkey").cast("string").alias("video"), F.col("p_name").alias("question"), F.col("p_brand").alias("answer"),
        F.array("p_brand").alias("candidates"), F.col("p_partkey").alias("pos"),
    )
    table = PR.task_table({"Ship": (orders, "ship/", "video", True), "Part": (part, "part/", "frame", False)})
    return table.na.fill(-1.0, ["start", "end"]).drop("candidates")


@query("""SELECT page_id, md5(html) AS digest, CASE WHEN page_id % 3 = 0 THEN md5(url) ELSE 'none' END AS expected FROM pages WHERE page_id % 3 = 0 OR length(url) > 60""")
def payload_md5(src: Source) -> DataFrame:
    """Pages whose digest is not the expected one (every third row, and long addresses, expect another)."""
    pages = src.table("pages")
    other = F.when(F.col("page_id") % 3 == 0, F.md5(F.col("url").cast("binary"))).when(F.length("url") > 60, "none")
    expected = pages.select("page_id", F.coalesce(other, F.md5(F.col("html").cast("binary"))).alias("expected"))
    return TB.check_md5(pages, expected, ["page_id"], "html")


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS video_path FROM orders ANTI JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def missing_media(src: Source) -> DataFrame:
    """Orders whose customer has no positive balance, as rows whose media file is missing."""
    files = src.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"))
    table = src.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("video_path"))
    return TB.missing_media(table, files).select("o_orderkey", "video_path")


@query("""
    WITH s AS (SELECT lang, source, avg(CAST(regexp_matches(text, '[一-鿿]') AS INT)) AS cn_ratio, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, source, cn_ratio, n, CASE WHEN n < 20 AND cn_ratio > 0.5 THEN 'culture_cn' WHEN n < 20 THEN 'unknown' WHEN cn_ratio > 0.5 THEN 'general_cn' ELSE 'general_en' END AS guess FROM s""")
def dataset_guess(src: Source) -> DataFrame:
    rows = src.table("documents").withColumnRenamed("text", "question")
    return TB.guess_dataset(rows, by=["lang", "source"], small=20)


@query("""SELECT o_orderpriority AS dataset, CASE o_orderpriority WHEN '1-URGENT' THEN 'VQA' WHEN '2-HIGH' THEN 'Y/N' ELSE 'MCQ' END AS kind, count(*) AS n,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'none' ELSE 'chatgpt-0125' END AS judge FROM orders GROUP BY ALL
    UNION ALL SELECT 'openEnded ' || o_orderstatus, 'VQA', count(*), 'none' FROM orders GROUP BY ALL""")
def dataset_kinds(src: Source) -> DataFrame:
    """Task kind and judge of every run, from the registry, the name or the default."""
    orders = src.table("orders")
    names = orders.select(F.col("o_orderpriority").alias("dataset")).unionByName(
        orders.select(F.concat(F.lit("openEnded "), "o_orderstatus").alias("dataset"))
    )
    extra = [schema.DatasetInfo("1-URGENT", "VQA"), schema.DatasetInfo("2-HIGH", "Y/N")]
    kinds = schema.dataset_kind(names, schema.registry_table(src.spark, extra))
    judged = kinds.withColumn("judge", F.coalesce(schema.judge_for(F.col("dataset"), F.col("kind")), F.lit("none")))
    return judged.groupBy("dataset", "kind", "judge").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def tsv_round_trip(src: Source) -> DataFrame:
    """Documents written as fully quoted TSV and read back, line breaks and quotes included."""
    path = session.new_table_path(src.spark, "documents") + ".tsv"
    docs = src.table("documents")
    TB.write_table(docs.select("doc_id", "text", "lang", "n_chars"), path)
    back = TB.read_table(src.spark, path, schema="doc_id bigint, text string, lang string, n_chars bigint")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "n_chars")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_round_trip(src: Source) -> DataFrame:
    path = session.new_table_path(src.spark, "turns") + ".jsonl"
    TB.write_table(src.table("conversations"), path)
    back = TB.read_table(src.spark, path, schema=schema.SCHEMAS["turns"])
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(with_view(FX.RUNS, " SELECT model, dataset, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM fx WHERE dataset = '1-URGENT' GROUP BY ALL"))
def partitioned_results(src: Source) -> DataFrame:
    """Results written one folder per run and read back with partition pruning."""
    path = session.new_table_path(src.spark, "results")
    TB.write_results(src.view(FX.RUNS).select("model", "dataset", "idx", "hit"), path)
    back = TB.read_table(src.spark, path, "parquet")
    return back.where("dataset = '1-URGENT'").groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


@query("""SELECT o_orderkey AS idx, o_orderkey % 1000000 AS gid, CAST(FLOOR(o_orderkey / 1000000) AS BIGINT) AS rolling FROM orders""")
def index_parts(src: Source) -> DataFrame:
    """Index space of circular copies, after typing the index from its text."""
    orders = src.table("orders").select(F.col("o_orderkey").cast("string").alias("index"))
    typed = TB.typed_index(orders)
    return typed.select(F.col("index").alias("idx"), OK.main_key("index").alias("gid"), OK.rotation("index").alias("rolling"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n, md5(coalesce(array_to_string(string_split(text, chr(10)), '#'), '')) AS digest FROM documents""")
def list_cells(src: Source) -> DataFrame:
    """Whole texts as list literals, read back as arrays."""
    cells = src.table("documents").select("doc_id", F.to_json(F.split("text", "\n")).alias("cell"))
    items = cells.select("doc_id", T.to_list("cell").alias("items"))
    return items.select("doc_id", F.size("items").cast("bigint").alias("n"), F.md5(F.array_join("items", "#").cast("binary")).alias("digest"))


@query(with_view(FX.MCQ, """ SELECT model, idx, prediction, row_number() OVER (ORDER BY model, idx) - 1 AS row_no FROM fx"""))
def ordered_sink(src: Source) -> DataFrame:
    """Predictions written in order over several files; the place of each row follows from the manifest and its place in its file."""
    path = session.new_table_path(src.spark, "ordered")
    OR.write_ordered(src.view(FX.MCQ).select("model", "idx", "prediction"), path, ["model", "idx"])
    return OR.read_ordered(src.spark, path)
