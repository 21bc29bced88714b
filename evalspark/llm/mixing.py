"""Mixing sources to target weights, in DataFrame operations only.

Words of a source are laid out one document after another and packed into blocks of a fixed number of words.  A source's target
is its weight's share of the wanted total, at most twice its size; what is above is shared again by weight, which is a water
level: target = min(2 * size, level * weight).  Its slots (target / block) are thrown at output shards one by one, each shard
alike, so a shard's counts by source are a multinomial draw whose totals are the targets.  A slot's number goes through a
pseudorandom permutation of its source's block numbers, another one for each pass over them, so no block is taken twice before all are
taken once.  Slots and blocks are joined by source and block number.

Offsets are two sums: within buckets of a source and over a source's buckets; a source with a third of all rows is cut in as many
buckets as the square root of the rows.  Slots are counted out in chunks, so no task makes all slots of a source.

Cases: null texts and texts of white space have no words, are never taken and get no words; rows without a source are a source of
their own, the last one; repeated rows are rows of their own; with no words at all nothing is taken; an empty table gives an empty table;
columns of other names pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, slots of a shard on average, slots counted out by one row.
BLOCK, SHARD, CHUNK = 128, 4_096, 4_096
#: Prime multipliers, greater than any number of blocks, so coprime to it.
PRIMES = (1000000000000000003, 1000000000000000009)


def sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_no, source_size, target`` of each source; ``sized`` has ``source, size``.  One row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    listed = totals.withColumn("source_no", number.cast("long")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = listed.withColumn("level", level)
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)
    target = F.coalesce(F.least("cap", found["level"] * F.col("weight")), F.col("cap"))
    return levels.select("source", "source_no", "source_size", target.alias("target"))


def _spin(i: Column, n: Column, salt: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0 .. n - 1: multiply and shift, turn each stretch by a hash of its number, multiply and shift."""

    def affine(x: Column, prime: int, kind: int) -> Column:
        shift = F.pmod(F.xxhash64(salt, F.lit(seed), F.lit(kind)), n)
        return ((F.lit(str(prime)).cast("decimal(19,0)") * x.cast("decimal(18,0)") + shift) % n).cast("long")

    stretch = F.greatest(F.floor(F.sqrt(n)).cast("long"), F.lit(1).cast("long"))
    x = affine(i, PRIMES[0], 1)
    row, place = F.floor(x / stretch).cast("long"), x % stretch
    turned = row * stretch + F.pmod(place + F.pmod(F.xxhash64(row, salt, F.lit(seed)), stretch), stretch)
    return affine(F.when(row < F.floor(n / stretch), turned).otherwise(x), PRIMES[1], 2)


def slots(targets: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """``shard, source_no, slot, pass, block, words``: every slot of the mix, the block it takes and how many of its words."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.round("target").cast("long")
    # Whole passes take every block of the source; the rest is drawn block by block, the last one as far as needed.
    rest = wanted - F.floor(wanted / F.col("source_size")).cast("long") * F.col("source_size")
    whole = F.floor(wanted / F.col("source_size")).cast("long") * n
    shards = F.greatest(F.ceil(F.sum("n_slots").over(Window.partitionBy()) / shard), F.lit(1))
    counted = targets.filter("source_size > 0").withColumn("n_slots", whole + F.ceil(rest / block).cast("long")).withColumn("n_shards", shards)
    chunks = counted.filter("n_slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition("source_no", "chunk")
    own = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1)
    # A pass over a part of the blocks leaves the short last one out, if the others are enough.
    drawn = F.when((F.col("slot") >= whole) & (F.ceil(rest / block) < n), n - 1).otherwise(n)
    made = chunks.withColumn("slot", F.explode(own)).withColumn("pass", F.floor(F.col("slot") / n).cast("long"))
    return made.select(
        F.pmod(F.xxhash64("source_no", "slot", F.lit(seed)), F.col("n_shards")).alias("shard"), "source_no", "slot", "pass",
        _spin(F.col("slot") % n, drawn, F.hash("source_no", "pass"), seed).alias("block"),
        F.when(F.col("slot") < whole, F.lit(block)).otherwise(F.least(F.lit(block), rest - (F.col("slot") - whole) * block)).cast("long").alias("words"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = 1, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and the pieces of them that the mix takes.

    First: ``row, <key>, size, source_no, source_size, target``.  Second: ``shard, source_no, slot, pass, block, row, start, words``:
    words ``start`` (from 0) and following of a row, in a slot of a shard.  ``row``: the rows' own number, if they have one.
    """
    number = F.monotonically_increasing_id() if row is None else row
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialise(docs.select(number.alias("row"), F.col(key), F.col(source).alias("source"), size.alias("size")), "sizes")
    targets = materialise(sources(sized), "targets")
    buckets = max(1, math.isqrt(sized.count()))
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("row", key, "size", "source_no", "source_size", "target")
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(key, "row"), F.lit(buckets)))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("source_no", "bucket").orderBy(key, "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins, ["source_no", "bucket"])
    begin = F.col("begin") + F.col("inner")
    spans = laid.filter("size > 0").select(
        "row", "source_no", "size", begin.alias("begin"),
        F.explode(F.sequence(F.floor(begin / block).cast("long"), F.floor((begin + F.col("size") - 1) / block).cast("long"))).alias("block"),
    )
    # Both sides grow with the data, though the slots are counted out from a small table: never a broadcast.
    met = spans.join(slots(targets, block, shard, seed).hint("merge"), ["source_no", "block"])
    start = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    end = F.least(F.col("block") * block + F.col("words") - F.col("begin"), F.col("size"))
    pieces = met.withColumn("start", start).withColumn("n", end - start).filter("n > 0")
    return rows, pieces.select("shard", "source_no", "slot", "pass", "block", "row", "start", F.col("n").alias("words"))


def taken_words(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``<key>, size, source_size, target, taken`` of every row."""
    rows, pieces = mix(docs, key, **options)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix by document: rows of which words are taken, with what is taken as text.

    A pass that takes all words of a row gives its text as it is, a pass that takes some gives those words, one space between; a
    second pass follows the first on a line of its own.
    """
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "mixed")
    rows, pieces = mix(numbered, text=text, row=F.col("__row"), **options)
    passes = pieces.groupBy("row", "pass").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("start", "words"))).alias("pieces"))
    whole = passes.join(rows.select("row", "size"), "row").select("row", F.struct("pass", (F.col("taken") == F.col("size")).alias("whole"), "pieces").alias("of"))
    listed = whole.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list("of")).alias("__passes"))
    met = numbered.join(listed, "__row").withColumn("__words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    some = lambda of: F.array_join(F.flatten(F.transform(of["pieces"], lambda p: F.slice("__words", (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    taken = F.transform("__passes", lambda of: F.when(of["whole"], F.col(text)).otherwise(some(of)))
    return met.withColumn(text, F.array_join(taken, "\n")).select(*docs.columns)
