"""Removal of repeated strings: a byte goes if a string of 100 bytes that covers it also starts earlier; the first copy stays.

Every string of 100 bytes has an anchor: the least hash among its substrings of 32 bytes, the leftmost if there are several.  Equal
strings have equal anchors at equal places, so a string's earlier copies are found among the places with its anchor.  Neighbouring
strings mostly share one anchor; they are a run, one row.

1. Rows (anchor, digest of all bytes of the run, place) are sorted by anchor and digest.  Anchors that stand alone end here.  A run
   whose digest also stands earlier is wholly repeated; equal runs of one slice of texts are reduced to the earliest before the shuffle.
2. Where an anchor has different runs (beginnings and ends of passages, edits), each one's bytes are fetched and the runs of an
   anchor are sorted by their first 100 bytes, equal ones by place.  A string equal to the one before it is repeated; longest previous
   factors and smaller positions are not computed.
   Strings whose rolling hash no other string of the anchor has are left out before sorting, as they have no match of that length.
3. Anchors with very many different runs would gather in one task; their strings are grouped by content instead, which keeps the
   least place of each and is reduced before it is shuffled.
4. Repeated runs are joined to their text, merged and cut out.

Cases: null and empty texts and texts under 100 bytes lose nothing; rows come in the order of their ids, rows without an id last, rows of one
id in the order of their texts' hashes; repeated rows are copies, the first stays; an empty table gives an empty table; columns other
than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.fingerprints import ranges
from evalspark.session import materialise

LENGTH, ANCHOR = 100, 32
#: Different runs of one anchor up to which they are compared in one task.
TOGETHER = 20_000
SLICE = 2 << 20
#: Strings that are put in suffix order at a time, unless one anchor has more.
STRINGS = 400_000
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by each worker."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE + (SLICE >> 2))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, brought to power 0, are hashes of substrings."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=out[1:])
    return out


def anchor_runs(blobs: list[bytes], length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Text number, anchor, digest, first start and number of strings of each run of each text."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return empty
    up, down = _powers(len(data) + 1)
    sums = _prefix(data)
    hashes = _scramble((sums[size:] - sums[:-size]) * down[:len(data) - size + 1])
    width = length - size + 1
    least, have = hashes, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    # A start is valid if its string ends within its text.
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(blobs)), sizes)[:len(least)]
    valid = np.arange(len(least)) + length <= ends[text]
    leaves = hashes[:len(least)] == least
    begins = valid & np.concatenate([[True], (least[1:] != least[:-1]) | leaves[:-1] | (text[1:] != text[:-1])])
    at = np.flatnonzero(begins)
    if not len(at):
        return empty
    # The run ends before the next one begins, and within its text.
    following = np.append(at[1:], len(least))
    last = np.minimum(following, ends[text[at]] - length + 1)
    count = last - at
    stop = at + count - 1 + length
    digest = _scramble((sums[stop] - sums[at]) * down[at] ^ (count.astype(np.uint64) * np.uint64(_BASE)))
    return text[at], least[at], digest, at - (ends - sizes)[text[at]], count


def _slices(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for at, blob in enumerate(blobs):
        size += len(blob)
        if size >= SLICE or at == len(blobs) - 1:
            yield first, at + 1
            first, size = at + 1, 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, blobs = batch.column("row").to_numpy(), [t.encode() for t in batch.column("body").to_pylist()]
        for first, last in _slices(blobs):
            text, anchor, digest, start, count = anchor_runs(blobs[first:last])
            row, run = rows[first:last][text], start * 128 + count
            # All but the earliest of equal runs are known to be repeated here already: they need no anchor, and go anywhere.
            order = np.lexsort((run, row, digest, anchor))
            anchor, digest, row, run = anchor[order], digest[order], row[order], run[order]
            if len(run):
                known = np.flatnonzero(np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])]))
                anchor[known], digest[known] = _scramble(row[known].astype(np.uint64) * np.uint64(_BASE) + run[known].astype(np.uint64)), 0
                run[known] = -run[known]
            for begin in range(0, len(run), 50_000):
                cut = slice(begin, begin + 50_000)
                yield pa.RecordBatch.from_arrays([_signed(anchor[cut]), _signed(digest[cut]), _signed(row[cut]), _signed(run[cut])], ["anchor", "digest", "row", "run"])


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, digest and place: runs that stand earlier, and runs that must be compared.  Keeps two rows."""
    before, first, told = None, None, True
    for batch in batches:
        if not len(batch):
            continue
        data = np.stack([batch.column(c).to_numpy() for c in ("anchor", "digest", "row", "run")])
        known = data[3] < 0
        if known.any():
            own = np.abs(data[:, known])
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(data[2, known]), pa.array(own[3] // 128), pa.array(own[3] % 128), pa.array(np.zeros(own.shape[1], bool))], ["anchor", "row", "start", "n", "open"])
            data = data[:, ~known]
            if not data.shape[1]:
                continue
        whole = data if before is None else np.concatenate([before[:, None], data], axis=1)
        same_anchor = whole[0, 1:] == whole[0, :-1]
        same_run = same_anchor & (whole[1, 1:] == whole[1, :-1])
        if before is None:
            same_anchor, same_run = np.concatenate([[False], same_anchor]), np.concatenate([[False], same_run])
        compare = same_anchor & ~same_run
        # The first run of an anchor is compared too, as soon as there is another one.
        group = np.cumsum(~same_anchor)
        heads = np.flatnonzero(~same_anchor)
        wanted = np.unique(group[compare])
        extra = []
        if len(wanted) and wanted[0] == 0 and not told:
            extra.append(first[:, None])
            told = True
        extra.append(data[:, heads[wanted[wanted > 0] - 1]])
        out = np.concatenate([data[:, same_run], data[:, compare], *extra], axis=1)
        open_rows = np.ones(out.shape[1], bool)
        open_rows[:int(same_run.sum())] = False
        if len(heads):
            first, told = data[:, heads[-1]], group[-1] in wanted
        before = data[:, -1]
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[2]), pa.array(out[3] // 128), pa.array(out[3] % 128), pa.array(open_rows)], ["anchor", "row", "start", "n", "open"])


def longest_previous(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Whether the first ``length`` bytes of each string also stand in its group before it.

    The strings are sorted by their first ``length`` bytes, by words of eight bytes, equal ones by place.
    """
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    keys = []
    for w in range(words):
        word = np.zeros(len(starts), np.uint64)
        for i in range(8):
            if 8 * w + i < length:
                word = (word << np.uint64(8)) | padded[starts + 8 * w + i]
        keys.append(word)
    order = np.lexsort([*reversed(keys), groups])
    same = groups[order][1:] == groups[order][:-1]
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    # lexsort keeps the order of equal strings, which is that of their places: the suffix before one of full match is its previous
    # smaller position, and a string without a full match before it has none after it either.
    found = np.zeros(len(starts), bool)
    found[order[1:]] = same
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by anchor and place, with their bytes: the stretches of starts whose strings stand earlier."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch.column("n").to_numpy().sum())
        if size >= STRINGS:
            table = pa.Table.from_batches(held).combine_chunks()
            anchors = table.column("anchor").to_numpy()
            cut = int(np.flatnonzero(anchors == anchors[-1])[0])
            if cut:
                yield from _stretches(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), int(table.slice(cut).column("n").to_numpy().sum())
    if size:
        yield from _stretches(pa.Table.from_batches(held))


def _stretches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    blobs = table.column("bytes").to_pylist()
    n, row, start = (table.column(c).to_numpy() for c in ("n", "row", "start"))
    data = np.frombuffer(b"".join(blobs), np.uint8)
    offset = np.cumsum([0, *map(len, blobs[:-1])])
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = offset[run] + within
    _, group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
    sums, (_, down) = _prefix(data), _powers(len(data) + 1)
    rolled = _scramble((sums[at + LENGTH] - sums[at]) * down[at] + group[run].astype(np.uint64) * np.uint64(_BASE))
    _, back, seen = np.unique(rolled, return_inverse=True, return_counts=True)
    some = np.flatnonzero(seen[back] > 1)
    repeated = np.zeros(len(run), bool)
    if len(some):
        # By place: the rows are sorted by text and start within an anchor.
        repeated[some] = longest_previous(data, at[some], group[run[some]], LENGTH)
    opens = repeated & np.concatenate([[True], ~repeated[:-1] | (run[1:] != run[:-1])])
    closes = repeated & np.concatenate([~repeated[1:] | (run[1:] != run[:-1]), [True]])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    yield pa.RecordBatch.from_arrays([pa.array(row[run[a]]), pa.array(start[run[a]] + within[a]), pa.array(b - a + 1)], ["row", "start", "n"])


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, <key>, body``: ``row`` is the id where ids are whole and unique, else a number in the order of the rows, written once."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    whole = docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        return rows.select(F.col(key).cast("long").alias("row"), key, "body")
    placed = rows.withColumn("range", ranges(rows, key))
    before = placed.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col(key).asc_nulls_last(), F.xxhash64("body")))
    return materialise(placed.withColumn("place", place).join(before.drop("count"), "range").select((F.col("before") + F.col("place")).alias("row"), key, "body"), "numbered")


def repeated_runs(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``row, start, n``: runs of starts whose strings of 100 bytes also start earlier.  ``rows``: ``row, body``."""
    runs = rows.filter(F.octet_length("body") >= LENGTH).select("row", "body").mapInArrow(_anchors, "anchor long, digest long, row long, run long")
    kinds = runs.repartition("anchor").sortWithinPartitions("anchor", "digest", "row", "run").mapInArrow(_sorted_out, "anchor long, row long, start long, n long, open boolean")
    kinds = materialise(kinds, "runs")
    open_runs = kinds.filter("open").select("anchor", "row", "start", "n")
    by_row = open_runs.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    body = F.encode("body", "UTF-8")
    cut = rows.join(by_row, "row").select("row", body.alias("bytes"), F.explode("runs").alias("run")).select(
        "run.anchor", "row", "run.start", "run.n", F.substring(F.col("bytes"), (F.col("run.start") + 1).cast("int"), (F.col("run.n") + LENGTH - 1).cast("int")).alias("bytes")
    )
    crowded = open_runs.groupBy("anchor").count().filter(F.col("count") > together).select("anchor")
    crowded = materialise(crowded, "crowded")
    found = kinds.filter("not open").select("row", "start", "n")
    few = cut if crowded.isEmpty() else cut.join(crowded, "anchor", "left_anti")
    ordered = few.repartition("anchor").sortWithinPartitions("anchor", "row", "start")
    found = found.unionByName(ordered.mapInArrow(_compared, "row long, start long, n long"))
    if not crowded.isEmpty():
        strings = cut.join(crowded, "anchor").select("row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(
            (F.col("start") + i).alias("start"), F.substring(F.col("bytes"), (i + 1).cast("int"), F.lit(LENGTH)).alias("string")))).alias("of")).select("row", "of.start", "of.string")
        strings = materialise(strings, "strings")
        earliest = strings.groupBy("string").agg(F.min(F.struct("row", "start")).alias("least"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
        later = strings.join(earliest, "string").filter(F.struct("row", "start") != F.col("least"))
        found = found.unionByName(later.select("row", "start", F.lit(1).cast("long").alias("n")))
    return found


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs``: ``<key>, n_bytes, spans, n_removed, n_spans, kept``: removed spans (start, end) and remaining bytes."""
    rows = numbered(docs, key, text)
    runs = materialise(repeated_runs(rows, together), "repeats")
    by_row = runs.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    names = ["spans", "n_removed", "n_spans", "kept"]
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    @F.arrow_udf("struct<spans:array<struct<start:long,end:long>>,n_removed:long,n_spans:long,kept:binary>")
    def cut_out(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, own in zip(bodies.to_pylist(), lists.to_pylist(), strict=True):
            blob, spans = body.encode(), []
            for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + LENGTH) for r in own or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            edges = [0, *(e for span in spans for e in span), len(blob)]
            kept = b"".join(blob[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append({"spans": [{"start": a, "end": b} for a, b in spans], "n_removed": len(blob) - len(kept), "n_spans": len(spans), "kept": kept})
        return pa.array(out, kind)

    met = rows.join(by_row, "row", "left").withColumn("of", cut_out("body", "runs"))
    return met.select(key, F.octet_length("body").cast("long").alias("n_bytes"), *(f"of.{n}" for n in names))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
