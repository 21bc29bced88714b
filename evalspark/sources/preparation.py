"""Benchmark preparation: shared images, payload tables, combined data sets, JSON sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.operators.order import number_rows

PAYLOAD_LENGTH = 64


def resolve_images(table: DataFrame, index: str = "index", image: str = "image", by: Sequence[str] = ()) -> DataFrame:
    """Replace cells that name another row by that row's payload.

    Only rows with a reference are joined; payload rows pass through.  ``image_error`` marks references to
    nothing or to another reference.
    """
    is_payload = F.length(image) > PAYLOAD_LENGTH
    own = table.where(is_payload).withColumn("image_error", F.lit(False))
    source = table.where(is_payload).select(*by, F.col(index).cast("string").alias(image), F.col(image).alias("_payload"))
    referring = table.where(~is_payload).join(source, [*by, image], "left")
    resolved = referring.withColumn("image_error", F.col("_payload").isNull()).withColumn(
        image, F.coalesce("_payload", image)
    )
    return own.unionByName(resolved.select(*own.columns))


def image_key(index: Column | str, image: Column | str) -> Column:
    """Index of the row that holds the payload: the row itself or the one its cell names."""
    cell = T.col(image)
    return F.when(F.length(cell) > PAYLOAD_LENGTH, T.col(index).cast("string")).otherwise(cell)


def payload_table(table: DataFrame, image: str = "image", path: str = "image_path") -> DataFrame:
    """Binary payloads by path: ``dataset, path, content, payload_error``; several images get a numbered path each.

    A cell too short to be a payload (see ``PAYLOAD_LENGTH``) has no content and the error mark.
    """
    images = T.to_list(image)
    paths = T.to_list(path)
    stem = F.regexp_extract(F.get(paths, F.lit(0)), "^(.*?)(\\.[^.]*)?$", 1)
    ending = F.regexp_extract(F.get(paths, F.lit(0)), "(\\.[^.]*)?$", 0)
    numbered = F.transform(images, lambda x, i: F.concat(stem, F.lit("_"), i.cast("string"), ending))
    own_paths = F.when((F.size(images) > 1) & (F.size(paths) == 1), numbered).otherwise(paths)
    zipped = F.arrays_zip(own_paths.alias("path"), images.alias("image"))
    rows = table.select("dataset", F.explode_outer(zipped).alias("x"))
    is_payload = F.coalesce(F.length("x.image") > PAYLOAD_LENGTH, F.lit(False))
    return rows.select("dataset", F.col("x.path").alias("path"), F.when(is_payload, F.unbase64("x.image")).alias("content"), (~is_payload).alias("payload_error"))


def localise_paths(table: DataFrame, index: str = "index", image: str = "image") -> DataFrame:
    """Drop payloads and add the path of the image each row uses."""
    if "image_path" in table.columns:
        return table.drop(image)
    return table.withColumn("image_path", F.concat(image_key(index, image), F.lit(".jpg"))).drop(image)


def concat_datasets(tables: Mapping[str, DataFrame], order: str = "index") -> DataFrame:
    """Union of data sets tagged ``sub_dataset``; ``index`` is renumbered, the old one kept.

    Numbering is by (table, old index) in two steps, so that no single task orders all rows: rows are
    numbered inside blocks between quantiles and block offsets are added from the block counts.
    """
    merged: DataFrame | None = None
    for place, (name, table) in enumerate(tables.items()):
        tagged = table.withColumns({"sub_dataset": F.lit(name), "_place": F.lit(place)})
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    assert merged is not None
    renamed = merged.withColumnRenamed(order, "original_index")
    return number_rows(renamed, ["_place"], "original_index", "index").drop("_place")


def split_concat(scored: DataFrame) -> DataFrame:
    """Rows of a combined data set under their own data set name and index again."""
    return scored.drop("index", "dataset").withColumnsRenamed({"original_index": "index", "sub_dataset": "dataset"})


# ------------------------------------------------------------------ JSON sources
DIAGRAM_SCHEMA = (
    "imageName string, questions map<string, struct<questionId:string, answerTexts:array<string>, "
    "correctAnswer:int, abcLabel:boolean>>"
)


def diagram_questions(documents: DataFrame, categories: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Four-option questions of diagram documents: index ``main * 100 + sub`` from ``<main>.png-<sub>``."""
    name = F.split_part("imageName", F.lit("."), F.lit(1))
    rows = (
        documents.withColumn("image_id", name)
        .join(test_ids.select("image_id"), "image_id", "left_semi")
        .join(categories.select("imageName", "category"), "imageName", "left")
        .select("imageName", "category", F.explode("questions").alias("question", "q"))
    )
    key = F.split("q.questionId", ".png-", -1)
    options = {c: F.get("q.answerTexts", F.lit(i)) for i, c in enumerate("ABCD")}
    out = rows.select(
        (F.get(key, F.lit(0)).cast("bigint") * 100 + F.get(key, F.lit(1)).cast("bigint")).alias("index"),
        "question", *[v.alias(c) for c, v in options.items()],
        T.letter_at(F.col("q.correctAnswer")).alias("answer"), "category", F.col("q.abcLabel").alias("abcLabel"), "imageName",
    )
    folder = F.when(uses_letter_labels("abcLabel", "question"), "images_abc/").otherwise("images/")
    return out.withColumn("image_path", F.concat(folder, F.col("imageName"))).drop("imageName")


def _label_like(option: Column) -> Column:
    """Option text that looks like diagram labels: short marks, stages, or several of them."""
    def label(s: Column) -> Column:
        bare = F.regexp_replace(s, "^(Stage )+", "")
        return bare.isin("{}", "Both", "None of above") | (F.length(bare) <= 2)

    parts = F.split(option, " and ")
    pieces = T.words(T.clean_punctuation(option))
    return (
        label(option)
        | ((F.size(parts) > 1) & F.forall(parts, label))
        | ((F.size(pieces) > 1) & F.forall(pieces, label))
    )


def uses_letter_labels(flag: str, question: str, options: Sequence[str] = tuple("ABCD")) -> Column:
    """Question about letter labels: three label-like options, or a one-letter word in the question."""
    count = sum((_label_like(F.col(c)).cast("int") for c in options), F.lit(0))
    single = F.exists(T.words(T.clean_punctuation(question)), lambda w: w.rlike("^[A-Za-z]\\z"))
    return F.col(flag).cast("boolean") & ((count >= 3) | single)


def options_table(items: DataFrame, header: str) -> DataFrame:
    """Items with an options array: letters A-E from the fifth character on, options joined below a header."""
    options = F.col("multi-choice options")
    letters = {c: F.substr(F.get(options, F.lit(i)), F.lit(5)) for i, c in enumerate("ABCDE")}
    joined = F.concat(F.lit(header), F.array_join(options, "\n"))
    rest = [c for c in items.columns if c != "multi-choice options"]
    return items.select(*rest, joined.alias("multi-choice options"), *[v.alias(c) for c, v in letters.items()])


def task_table(sources: Mapping[str, tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """Union of per-task items: ``task -> (items, path prefix, media type, has bounds)``."""
    merged: DataFrame | None = None
    for place, (task, (items, prefix, media, bound)) in enumerate(sources.items()):
        ends = [F.col(c).cast("double").alias(c) if c in items.columns else F.lit(None).cast("double").alias(c)
                for c in ("start", "end")]
        rows = items.select(
            F.lit(task).alias("task_type"), F.lit(prefix).alias("prefix"), F.lit(media).alias("data_type"),
            F.lit(bound).alias("bound"), *ends, "video", "question", "answer", "candidates", "pos", F.lit(place).alias("_place"),
        )
        merged = rows if merged is None else merged.unionByName(rows)
    assert merged is not None
    return number_rows(merged, ["_place"], "pos", "index").drop("_place", "pos")


def task_map_table(document: DataFrame) -> DataFrame:
    """Rows of a ``{root: {task: path}, meta: {task: [item]}}`` document."""
    tasks = document.select("root", F.explode("meta").alias("task_type", "items"))
    rows = tasks.select("task_type", F.try_element_at("root", F.col("task_type")).alias("prefix"), F.posexplode("items").alias("pos", "x"))
    return rows.select("task_type", "prefix", "pos", "x.video", "x.question", "x.answer", "x.candidates")


def options_into_question(items: DataFrame, video_id: str = "videoID") -> DataFrame:
    """Question followed by its option lines, with the media paths of its video."""
    vid = F.col(video_id)
    return items.select(
        "index", vid.alias("video"), F.concat(F.lit("./video/"), vid, F.lit(".mp4")).alias("video_path"),
        "duration", "domain", "sub_category", "task_type",
        F.concat(F.lit("./subtitle/"), vid, F.lit(".srt")).alias("subtitle_path"),
        F.concat_ws("\n", F.col("question"), F.array_join("options", "\n")).alias("question"), "answer",
    )


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """SubRip files as ``video, pos, start_ms, end_ms, text``, one row per cue; :func:`broken_cues` has what does not parse.

    Line ends may be ``\\n`` or ``\\r\\n``.  A file is one row while it is cut into cues.
    """
    cues = _cues(spark, path)

    def ms(first: int) -> Column:
        h, m, s, t = (F.regexp_extract("value", _CUE, first + i).cast("bigint") for i in range(4))
        return ((h * 60 + m) * 60 + s) * 1000 + t

    return cues.where(F.col("value").rlike(_CUE)).select(
        "video", F.regexp_extract("value", _CUE, 1).cast("bigint").alias("pos"), ms(2).alias("start_ms"),
        ms(6).alias("end_ms"), F.replace(T.strip(F.regexp_extract("value", _CUE, 10)), F.lit("\n"), F.lit("\\N")).alias("text"),
    )


_STAMP = "(\\d+):(\\d+):(\\d+)[,.](\\d+)"
_CUE = f"(?s)(\\d+)\\s*\\n{_STAMP} --> {_STAMP}[^\\n]*\\n(.*)"


def _cues(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.[^./]+$", 1).alias("video"), "value")
    unix = F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n"))
    return files.select("video", F.explode(F.split(unix, "\\n{2,}")).alias("value")).where(T.strip(F.col("value")) != "")


def broken_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues of each file that do not parse: ``video, n``."""
    return _cues(spark, path).where(~F.col("value").rlike(_CUE)).groupBy("video").agg(F.count(F.lit(1)).alias("n"))
