"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are normalised (each run of ASCII white space is one space) and cut into blocks of a fixed number of characters.  Distinct
blocks are sorted into integer names; then adjacent pairs of names are named in the same way, level by level, until each text has
one name.  Two texts have the same number of blocks and the same name exactly if they are equal: a name stands for one content and
never for a digest of it.  Blocks are grouped by their digest *and* content once; where two contents share a digest (which 64 bits
make rare, and tests force) they are told apart by their order, and the block's content is joined instead of its digest.

The text moves once, cut in blocks and reduced before the shuffle; later levels move integers.  Every level is a written table, so
its number does not lengthen the lineage.  A name that a third of all rows share is one row of the name table, and the join back
splits it.

Cases: null counts as the empty text, which is a text like others; repeated rows are copies of one another, one stays; rows
without an id stay only where no row of the group has one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialise

BLOCK = 4_096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def name_rows(distinct: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Distinct rows with an integer of their own: sorted within buckets of their hash, numbered there, buckets interleaved."""
    buckets = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)).cast("long") - 1
    return distinct.withColumn("__bucket", bucket).withColumn(name, place * buckets + F.col("__bucket")).drop("__bucket")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of a text; the empty text is one empty block."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``row, <key>, text_sha256, n_blocks, name`` of every row; ``row`` numbers the rows, and equal texts share (n_blocks, name)."""
    body = docs.select(F.col(key), normalised(text).alias("body"))
    listed = body.select(
        F.monotonically_increasing_id().alias("row"), F.col(key), F.sha2("body", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("body"), block), lambda b: digest(b)).alias("digests"),
    )
    rows = materialise(listed, "texts")
    blocks = body.select(F.explode(_blocks(F.col("body"), block)).alias("block")).withColumn("digest", digest(F.col("block")))
    # The sort: one row for each different block, reduced before it is shuffled.
    contents = blocks.groupBy("digest", "block").agg(F.lit(1).alias("one"))
    names = materialise(name_rows(contents.groupBy("digest").agg(F.count("*").alias("contents")), ["digest"]), "block-names")
    placed = rows.select("row", F.size("digests").alias("n_blocks"), F.posexplode("digests").alias("place", "digest"))
    level = placed.join(names.filter("contents = 1").select("digest", "name"), "digest").select("row", "n_blocks", "place", "name")
    if not names.filter("contents > 1").isEmpty():
        level = level.unionByName(_told_apart(docs, rows, names, contents, text, block, digest))
    level = materialise(level, "level")
    done, count = level.filter("n_blocks = 1").select("row", "name"), int(rows.agg(F.max(F.size("digests"))).first()[0] or 0)
    level = level.filter("n_blocks > 1")
    while count > 1:
        pairs = level.groupBy("row", F.floor(F.col("place") / 2).alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialise(pairs, "pairs")
        names = name_rows(pairs.select("left", "right").distinct(), ["left", "right"])
        level = materialise(pairs.join(names, ["left", "right"]).select("row", "place", "name"), "level")
        count = -(-count // 2)
    whole = done.unionByName(level.select("row", "name")) if "n_blocks" not in level.columns else done
    return rows.select("row", key, "text_sha256", F.size("digests").alias("n_blocks")).join(whole, "row")


def _told_apart(docs, rows, names, contents, text, block, digest) -> DataFrame:
    """Places of blocks whose digest other contents share, named by digest and order of the content."""
    shared = names.filter("contents > 1").select("digest", "name")
    order = F.row_number().over(Window.partitionBy("digest").orderBy("block"))
    # Negative numbers: apart from all names of blocks alone with their digest.
    own = contents.join(shared, "digest").withColumn("order", order)
    own = own.select("digest", "block", (-1 - (F.col("name") * 2**20 + F.col("order"))).alias("name"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), _blocks(normalised(text), block).alias("blocks"))
    placed = numbered.select("row", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("place", "block")).withColumn("digest", digest(F.col("block")))
    return placed.join(own, ["digest", "block"]).select("row", "n_blocks", "place", "name")


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``<key>, keep_id, group_size, kept, text_sha256``."""
    named = identities(docs, key, text, **options)
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("row").alias("row"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select(
        key, F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    stay = group_copies(docs, key, text, **options).filter("kept").select(F.col(key).alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__own", F.sha2(normalised(text), 256))
    met = own.join(stay, (F.col("__own") == F.col("__sha")) & F.col(key).eqNullSafe(F.col("__id")))
    # Rows that repeat an id and its text are one row.
    once = F.row_number().over(Window.partitionBy("__own", key).orderBy(F.lit(0)))
    return met.withColumn("__once", once).filter("__once = 1").select(*docs.columns)
