"""Near duplicates by HyperMinHash.

A text's set is its distinct word shingles.  Shingle hashes are split into 128 buckets; each bucket keeps the least hash as a
register of 16 bits: how many zeros lead it, and ten bits after them.  Registers are compared in 32 bands of four; texts that
share a band are candidates.  For two texts of similarity 0.8 all bands miss with probability (1 - 0.8^4)^32, about 5e-8.  Empty
buckets take over the next filled one, so small sets fill all bands.

Candidates are then held against each other by sketches, and links are confirmed on the full sets.  The sketch of a set of up to
6,000 shingles has a bit for each of 2,048 cells: whether the cell got an odd number of shingles.  Two sets that differ in d
shingles differ in at most d bits, so of small sets no link can be refused; the bits allowed for large sets are six standard deviations
more than expected of the greatest d that a link can have.  Larger sets are compared by their registers (equal registers, less the chance
that different hashes have equal registers).

No pairs within a group are listed.  Texts with the same set are one node.  First each node of a band is compared with the band's
first node; linked nodes form components.  Then only bands whose nodes are still in several components are looked at again: nodes
outside one component of the band ask the band's other nodes, block by block inside a task.  In crowded bands each of them first names
its best other of each block only, and linked components are merged, for as long as that merges any.  What is left to ask is asked at
last in all bands, of everyone in another component; only pairs whose sketches are close enough leave the task and are confirmed.  Components are
found by passing on the least name and skipping along names, one written table per round.

Cases: null texts, empty texts and texts without words have the empty set and are linked with nothing; texts of fewer words than a
shingle have one shingle, all their words; repeated rows share a component; rows without an id count as greatest, and a component of
such rows alone has no id; an empty table gives an empty table; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialise

BUCKETS, BANDS, MANTISSA = 128, 32, 10
#: Chance that two different least hashes have the same register: the same zeros (1/3) and the same bits after them.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: Estimates so far below the wanted similarity are not looked at further.  A pair of similarity 0.8 falls below 0.58 with
#: binomial probability of about 1e-8, less than the bands miss.
MARGIN = 0.22
#: Bits of a sketch, and the most shingles of a set that has one.
CELLS, SKETCHED = 2048, 6000
#: Standard deviations that the sketches of a link may differ beyond what is expected; more has a chance of about 1e-9.
DEVIATIONS = 6
#: Nodes of a band that are compared with others at a time.
BLOCK = 2048
#: Bands with more nodes are asked for best others first.
CROWD = 32
#: Pairs that are estimated at a time, within a task.
PAIRS = 25_000
_MIX = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, cut at ASCII white space), one text after another, the words of each text, and last bytes."""
    blobs = [(t or "").encode("utf-8", "replace").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.cumsum([len(b) for b in blobs])
    inside = (data != 32) & ((data < 9) | (data > 13))
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    size = end - begin
    first = np.cumsum(size) - size
    where = np.flatnonzero(inside)
    place = (np.arange(len(where)) - np.repeat(first, size)).astype(np.uint64)
    mixed = _scramble(_MIX[data[where]] + place * _STEP)
    hashes = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    upto = np.searchsorted(begin, ends)
    return _scramble(hashes), np.diff(upto, prepend=0), data[end - 1]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts, _ = word_hashes(texts)
    sets, at = [], 0
    if len(hashes) >= width:
        joined = np.zeros(len(hashes) - width + 1, np.uint64)
        for i in range(width):
            joined = joined * _STEP + hashes[i:len(hashes) - width + 1 + i]
        joined = _scramble(joined)
    for count in counts:
        if count >= width:
            sets.append(np.unique(joined[at:at + count - width + 1]))
        elif count:
            whole = np.uint64(count)
            for h in hashes[at:at + count]:
                whole = np.uint64((int(whole) * int(_STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(_scramble(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += count
    return sets


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of a sorted set: 1 + zeros * 1024 + the next ten bits of the least hash of each bucket, 0 if it is empty."""
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    edges = np.arange(BUCKETS, dtype=np.uint64) << shift
    at = np.searchsorted(shingles, edges)
    least = np.append(shingles, np.uint64(0))[np.minimum(at, len(shingles))]
    filled = (at < len(shingles)) & ((least >> shift) == np.arange(BUCKETS, dtype=np.uint64))
    rest = (least << np.uint64(64) - shift) | np.uint64(1)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 56).astype(np.uint64)
    bits = (rest << zeros) << np.uint64(1) >> np.uint64(64 - MANTISSA)
    return np.where(filled, np.uint64(1) + zeros * np.uint64(1 << MANTISSA) + bits, np.uint64(0)).astype(np.uint16)


def band_keys(own: np.ndarray) -> np.ndarray:
    filled = np.flatnonzero(own)
    full = own[filled[np.searchsorted(filled, np.arange(BUCKETS)) % len(filled)]].astype(np.uint64).reshape(BANDS, -1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in full.T:
        keys = _scramble(keys * _STEP + column)
    return keys.astype(np.int64)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of each left row of registers with the right row at its place."""
    equal = ((left == right) & (left != 0)).sum(1)
    either = ((left | right) != 0).sum(1)
    return (equal / np.maximum(either, 1) - COLLISION) / (1 - COLLISION)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits of the cells that got an odd number of shingles; sketches of two sets differ in no more bits than the sets in shingles."""
    cells = np.bincount((shingles & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.packbits((cells & 1).astype(np.uint8))


def most_bits(total: np.ndarray, similarity: int) -> np.ndarray:
    """In how many bits the sketches of two linked sets of together ``total`` shingles may differ."""
    apart = total * (100 - similarity) / (100 + similarity)
    once, twice = (1 - 2 / CELLS) ** apart, (1 - 4 / CELLS) ** apart
    spread = np.sqrt(np.maximum(CELLS / 4 * (1 - twice) + CELLS * CELLS / 4 * (twice - once * once), 0))
    return np.minimum(apart + 1e-6, CELLS / 2 * (1 - once) + DEVIATIONS * spread)


def close_sets(similarity: int, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets can be linked, and about how like they are.  ``left``, ``right``: sizes, sketches (words) and registers, row by row."""
    close = 100 * np.minimum(left[0], right[0]) >= similarity * np.maximum(left[0], right[0])
    like = np.zeros(len(close))
    for large in (False, True):
        at = np.flatnonzero(close & ((np.maximum(left[0], right[0]) > SKETCHED) == large))
        if large:
            like[at] = estimate(left[2][at], right[2][at])
            close[at] = like[at] >= similarity / 100 - MARGIN
        else:
            total, bits = left[0][at] + right[0][at], np.bitwise_count(left[1][at] ^ right[1][at]).sum(1, dtype=np.int64)
            like[at] = 1 - bits / total
            close[at] = bits <= most_bits(total, similarity)
    return close, like


def _matrix(column: pa.Array, kind: type, size: int) -> np.ndarray:
    """Rows of ``size`` bytes; absent ones are zeros."""
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in column.to_pylist()), kind).reshape(len(column), -1)


def _sets_of(n: pa.Array, sketches: pa.Array, own: pa.Array) -> tuple[np.ndarray, ...]:
    return n.to_numpy(zero_copy_only=False), _matrix(sketches, np.uint64, CELLS // 8), _matrix(own, np.uint16, 2 * BUCKETS)


def signatures(docs: DataFrame, key: str, text: str, width: int, similarity: int) -> DataFrame:
    """``<key>, n_shingles, node, bands, sketch, registers``: equal sets have equal nodes.

    Sketches are of sets of up to 6,000 shingles, registers of those that may be linked with a larger one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                sets = shingle_sets(part.column("body").to_pylist(), width)
                own = [registers(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([band_keys(r) if len(s) else [] for s, r in zip(sets, own, strict=True)], pa.list_(pa.int64())),
                    pa.array([sketch(s).tobytes() if len(s) <= SKETCHED else b"" for s in sets], pa.binary()),
                    pa.array([r.tobytes() if 100 * len(s) >= similarity * SKETCHED else b"" for s, r in zip(sets, own, strict=True)], pa.binary()),
                ], ["id", "n_shingles", "node", "bands", "sketch", "registers"])

    made_rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(made, f"id {kind}, n_shingles long, node binary, bands array<long>, sketch binary, registers binary")
    return made_rows.withColumnRenamed("id", key)


def likely(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a, b`` whose sketches are close enough.  ``nodes``: ``node, n_shingles, sketch, registers``."""

    @F.arrow_udf("boolean")
    def close(n_a: pa.Array, sketch_a: pa.Array, own_a: pa.Array, n_b: pa.Array, sketch_b: pa.Array, own_b: pa.Array) -> pa.Array:
        return pa.array(close_sets(similarity, _sets_of(n_a, sketch_a, own_a), _sets_of(n_b, sketch_b, own_b))[0], pa.bool_())

    columns = ["n_shingles", "sketch", "registers"]
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]).hint("merge"), side)
    sizes = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * similarity
    return pairs.filter(sizes).filter(close(*[f"{c}_{side}" for side in ("a", "b") for c in columns])).select("a", "b")


def confirm(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], width: int, similarity: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough.  ``texts``: from wanted ``node`` to ``node, body``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                found = shingle_sets(part.column("body").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= similarity * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text of each node: of repeated rows any will do.
    once = texts(wanted).dropDuplicates(["node"])
    full = materialise(once.mapInArrow(sets, "node binary, shingles binary"), "sets")
    first = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    both = first.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return both.filter(similar("left", "right")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node that each linked node reaches.  ``links``: ``a, b``."""
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "components")
    while True:
        near = both.join(names.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = names.join(near, "node").select("node", "component", F.least("component", "near").alias("least"))
        # Skip along: the name of one's name.
        skip = names.select(F.col("node").alias("least"), F.col("component").alias("further"))
        moved = materialise(least.join(skip, "least", "left").select("node", F.col("component").alias("before"), F.least("least", F.coalesce("further", "least")).alias("component")), "components")
        names = moved.select("node", "component")
        if moved.filter("before <> component").isEmpty():
            return names


def _again(bands: DataFrame, nodes: DataFrame, names: DataFrame, similarity: int, best: bool) -> DataFrame:
    """Pairs of different components that share a band with several of them and whose sketches are close enough.

    ``best``: only the best pair of each asking node and block.  Sketches are fetched for nodes of such bands only.
    """
    named = bands.select("band", "node").join(names.hint("merge"), "node", "left").select("band", "node", F.xxhash64(F.coalesce("component", "node")).alias("component"))
    main = F.max_by("component", F.xxhash64("node")).alias("main")
    groups = named.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), main, F.count("*").alias("n"))
    open_groups = groups.filter("least <> most").select("band", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = named.join(open_groups.hint("merge"), "band").withColumn("asks", F.col("component") != F.col("main"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.hint("merge"), "node")
    # One task's share: blocks of bands, first the block's own nodes, those that ask last, then those of other blocks that ask, streamed.
    placed = met.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    spread = placed.withColumn("visits", F.col("block") != F.col("own")).select("band", "block", "visits", "asks", "component", "node", "n_shingles", "sketch", "registers")
    sorted_rows = spread.repartition("band", "block").sortWithinPartitions("band", "block", "visits", "asks")
    pairs = sorted_rows.mapInArrow(_close_pairs(similarity, best), "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _close_pairs(similarity: int, best: bool):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            before = 0 if carried is None else len(carried)
            if before:
                table = pa.concat_tables([carried, table])
            table = table.combine_chunks()
            if not len(table):
                continue
            band, block, component = (table.column(c).to_numpy() for c in ("band", "block", "component"))
            asks, visits = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "visits"))
            sets = _sets_of(*(table.column(c).combine_chunks() for c in ("n_shingles", "sketch", "registers")))
            group = np.cumsum(np.concatenate([[True], (band[1:] != band[:-1]) | (block[1:] != block[:-1])])) - 1
            first = np.searchsorted(group, np.arange(group[-1] + 1))
            # Own nodes of the block so far; those that come later ask what is here.
            there = np.bincount(group, weights=~visits).astype(np.int64)
            # Rows carried over, own nodes of the open block, have asked before.
            asking = np.flatnonzero(asks & (np.arange(len(asks)) >= before))
            nodes = table.column("node")
            at = 0
            while at < len(asking):
                upto = at + max(1, int(np.searchsorted(np.cumsum(there[group[asking[at:at + 50_000]]]), PAIRS)))
                part = asking[at:upto]
                at = upto
                count = there[group[part]]
                left = np.repeat(part, count)
                right = np.repeat(first[group[part]], count) + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
                n = sets[0]
                apart = (component[left] != component[right]) & (100 * np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]))
                left, right = left[apart], right[apart]
                close, like = close_sets(similarity, tuple(x[left] for x in sets), tuple(x[right] for x in sets))
                left, right, like = left[close], right[close], like[close]
                if best and len(left):
                    order = np.lexsort((-like, left))
                    left, right = left[order], right[order]
                    begins = np.append(True, left[1:] != left[:-1])
                    left, right = left[begins], right[begins]
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(left)).combine_chunks(), nodes.take(pa.array(right)).combine_chunks()], ["a", "b"])
            carried = table.filter(pa.array((group == group[-1]) & ~visits))

    return compared


def group_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``<key>, n_shingles, component_id, kept``.  ``similarity`` in percent of the union."""
    signed = materialise(signatures(docs, key, text, width, similarity), "signatures")
    own_id = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"))
    nodes = signed.filter("n_shingles > 0")
    # One row per node; which of equal rows is taken makes no difference.
    single = nodes.groupBy("node").agg(F.min(own_id).alias("first"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "registers")])
    single = materialise(single, "nodes")
    bands = single.select("node", F.explode("bands").alias("band"))
    several = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(bands.join(several.hint("merge"), "band"), "shared-bands")
    first = shared.groupBy("band").agg(F.min("node").alias("first"))
    stars = shared.join(first.hint("merge"), "band").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    found = signed.select(F.col(key).alias("__key"), "node").distinct()
    repeated = found.groupBy("__key").count().filter("count > 1").limit(1).count() > 0

    def texts(wanted: DataFrame, many: bool) -> DataFrame:
        if repeated:
            return _texts_of(docs, single, wanted, key, text, width, similarity)
        # Written, so that few wanted texts are not found by moving all texts; many are looked up in the same way at all sizes.
        ids = materialise(single.select("node", F.col("first.id").alias("__id")).join(wanted, "node", "left_semi"), "wanted")
        return docs.join(ids.hint("merge") if many else ids, F.col(key).eqNullSafe(F.col("__id"))).select("node", F.col(text).alias("body"))

    def linked(pairs: DataFrame, many: bool = False) -> DataFrame:
        return materialise(confirm(pairs, lambda wanted: texts(wanted, many), width, similarity), "links")

    sketches = single.select("node", "n_shingles", "sketch", "registers")
    links = linked(materialise(likely(stars, sketches, similarity), "stars"), many=True)
    names = components(links)
    # Pairs that are asked for join different components, so every link merges some.
    crowded = shared.filter(F.col("n") > CROWD)
    theirs = materialise(sketches.join(crowded.select("node").distinct(), "node", "left_semi"), "sketches")
    while True:
        more = materialise(_again(crowded, theirs, names, similarity, best=True), "best")
        if more.isEmpty() or (new := linked(more)).isEmpty():
            break
        links = links.unionByName(new)
        names = components(links)
    more = materialise(_again(shared, sketches, names, similarity, best=False), "pairs")
    if not more.isEmpty():
        names = components(links.unionByName(linked(more)))
    named = single.select("node", "first").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first").alias("id"))
    by_node = named.join(ids, "component").select("node", F.col("id.id").alias("component_id"))
    met = signed.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    return met.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def _texts_of(docs, single, wanted, key, text, width, similarity) -> DataFrame:
    """``node, body`` where ids repeat with different texts: the node is made again from each text."""
    made = signatures(docs.select(text).withColumn(key, F.col(text)), key, text, width, similarity).select("node", F.col(key).alias("body"))
    return made.join(wanted, "node", "left_semi")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with their own columns."""
    stay = group_near(docs, key, text, **options).filter("kept").select(F.col(key).alias("__id")).distinct()
    met = docs.join(stay, F.col(key).eqNullSafe(F.col("__id"))).drop("__id")
    once = F.row_number().over(Window.partitionBy(key, text).orderBy(F.lit(0)))
    return met.withColumn("__once", once).filter((F.col("__once") == 1) | F.col(key).isNull()).select(*docs.columns)
