"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a vocabulary has a white-space mark after another character, and none holds a line break, so no merge crosses the
place before a run of marks or before a line break.  Texts are cut at those places into chunks; each distinct chunk of the whole
corpus is segmented once, and its ids are joined back to where the chunk stood.  ``Pieces`` checks the property when the
model is loaded; for a vocabulary without it a whole text is one chunk.

1. ``asked``: texts are taken together in slices of many MB.  A slice lists its distinct chunks, most frequent first, deals
   them to buckets by digest, and asks each bucket with one packed row.
2. ``answered``: a bucket's requests are adjacent in one task, whatever slices they come from.  Its table of distinct chunks is filled
   from them; each chunk is segmented when it is first met, and every request gets the ids of its chunks, packed.  A word that every text holds
   comes once from a slice, so there is no hot key.  A table has at most ``TABLE`` chunks and is begun anew beyond; with more text, take more buckets.
3. ``placed``: each text as the places of its chunks in the slice's list, packed.  A second reading makes them, so that they need not be written
   first; ids and places meet slice by slice, and the ids go to their places.  A slice is named by its first row and its chunks: if a second
   reading differs (an input that is not the same each time it is read), its ids are missing and the job fails instead of mixing them up.

A text longer than a slice is cut into parts at chunk boundaries, which are slices of their own and are put together last.
What moves: distinct chunks of slices, their ids, and packed places, all compressed; never the texts.

``docs`` is read twice: give it as a table, or checkpointed.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows each get their row; an empty table gives an
empty table; columns of other names pass through, columns named like an output are replaced.  The text column itself is left
behind (``decode`` gives it back), so that it need not travel.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark.session import materialise

MARK = "▁"
#: Bytes of text in a slice; parts of a longer text have no more unless one chunk does.
SLICE = 8_000_000
#: Distinct chunks in a bucket's table.
TABLE = 500_000


class Pieces:
    """A sentencepiece model, loaded in each worker from the file's bytes; its size does not grow with the corpus."""

    def __init__(self, data: bytes):
        self.data, self._own = data, None

    def __getstate__(self):
        return {"data": self.data, "_own": None}

    @property
    def own(self):
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            self._mark = self._own.piece_to_id(MARK)
            pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
            # Normalising must change nothing but the mark in front, and must not join or drop spaces.
            plain = "".join(self._own.encode("a  ﬁ b ", out_type=str)) == f"{MARK}a{MARK * 2}ﬁ{MARK}b{MARK}"
            line = self._own.encode("\na")[:1] == [self._mark]
            self.by_chunk = plain and line and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        return self._own

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks: a run of spaces, or a line break, and what follows it.  The library puts a mark in front of what it is given."""
        own = self.own
        if not self.by_chunk:
            return own.encode(chunks, num_threads=1)
        found = own.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([self._mark] if c == " " else ids) if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text; texts have neither nulls nor empty ones."""
        if not self.own or not self.by_chunk:
            return pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1)), texts)
        # A character that no text has stands in front of each chunk; between the spaces of a run it goes again.
        cut = next(chr(c) for c in range(0xF8FF, 0xDFFF, -1) if not pc.any(pc.match_substring(texts, chr(c))).as_py())
        nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        marked = pc.binary_join_element_wise(nothing, pc.replace_substring(texts, MARK, " "), space)
        marked = pc.replace_substring(pc.replace_substring(marked, " ", cut + " "), "\n", cut + "\n")
        while pc.any(pc.match_substring(marked, f" {cut} ")).as_py():
            marked = pc.replace_substring(marked, f" {cut} ", "  ")
        return pc.split_pattern(marked, cut)


def load(spark: SparkSession, path: str | None = None):
    """The model as a broadcast; its size is that of one file."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return spark.sparkContext.broadcast(Pieces(file.read()))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of seven bits each, all first bytes before all second ones, and so on."""
    planes, rest, left = [], numbers.astype(np.uint32), np.arange(len(numbers))
    while len(left):
        more = rest >= 128
        planes.append((rest & 127 | more.astype(np.uint32) << 7).astype(np.uint8).tobytes())
        left, rest = left[more], rest[more] >> 7
    return b"".join(planes)


def _unpack(data: bytes, count: int) -> np.ndarray:
    found, left, at, shift = np.zeros(count, dtype=np.int64), np.arange(count), 0, 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while len(left):
        plane = raw[at:at + len(left)]
        found[left] |= (plane & 127).astype(np.int64) << shift
        at, shift, left = at + len(left), shift + 7, left[plane >= 128]
    return found


def _parts(lengths: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of chunks of about ``size`` bytes each."""
    ends, found, begin = np.cumsum(lengths), [], 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        found.append((begin, stop))
        begin = stop
    return found


def _gathered(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    """Rows of several batches together, about ``size`` bytes of text each; a text longer than that is alone."""
    held, total = [], 0
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for begin, stop in _parts(bytes_of, size):
            here = int(bytes_of[begin:stop].sum())
            if held and total + here > size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            held.append(batch.slice(begin, stop - begin))
            total += here
    if held:
        yield pa.Table.from_batches(held)


class Slice:
    """Some rows, or a part of one: their chunks as places in a list of distinct ones, most frequent first."""

    def __init__(self, rows: pa.Table, flat: pa.Array, of: np.ndarray, part: int, parts: int):
        encoded = flat.dictionary_encode()
        places = encoded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(places, minlength=len(encoded.dictionary)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.rows, self.part, self.parts = rows, part, parts
        self.places, self.bounds = rank[places], np.searchsorted(of, np.arange(len(rows) + 1))
        chunks = encoded.dictionary.take(pa.array(order)).cast(pa.large_binary())
        _, starts, data = chunks.buffers()
        self.n, self.bytes = len(chunks), data or pa.py_buffer(b"")
        self.starts = np.frombuffer(starts, np.int64)[chunks.offset:chunks.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.name = hashlib.blake2b(b"%d %d " % (rows.column("__row")[0].as_py(), part) + self.starts.tobytes() + memoryview(self.bytes), digest_size=16).digest()

    def buckets(self, count: int) -> np.ndarray:
        """The bucket of each chunk: its bytes as digits, modulo 2 ** 64, then mixed."""
        if not self.n:
            return np.zeros(0, np.uint16)
        lengths = np.diff(self.starts)
        data = np.frombuffer(self.bytes, np.uint8)[self.starts[0]:self.starts[-1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(data)) - np.repeat(self.starts[:-1] - self.starts[0], lengths)
        digits = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(data * digits[place], self.starts[:-1] - self.starts[0])
        return ((sums ^ sums >> np.uint64(32)) % np.uint64(count)).astype(np.uint16)

    def dealt(self, count: int) -> Iterator[tuple[int, int, bytes]]:
        """Of each bucket its number, and its chunks in the order of their places: how many, and their lengths and bytes."""
        of = self.buckets(count)
        order = np.argsort(of, kind="stable")
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.starts), self.bytes]).take(pa.array(order))
        starts, data = np.frombuffer(chunks.buffers()[1], np.int64)[:self.n + 1], memoryview(chunks.buffers()[2] or b"")
        ends = np.cumsum(np.bincount(of, minlength=count))
        for bucket in np.unique(of).tolist():
            first, last = int(ends[bucket - 1]) if bucket else 0, int(ends[bucket])
            yield bucket, last - first, _pack(np.diff(starts[first:last + 1])) + bytes(data[starts[first]:starts[last]])


def _slices(batches: Iterator[pa.RecordBatch], own: Pieces, text: str, size: int) -> Iterator[Slice]:
    for rows in _gathered(batches, text, size):
        texts = pc.fill_null(rows.column(text), "").cast(pa.large_string()).combine_chunks()
        said = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        lists = own.chunks(texts.take(pa.array(said)))
        flat, of = lists.flatten(), np.repeat(said, lists.value_lengths().to_numpy(zero_copy_only=False))
        if own.by_chunk:  # a text begins with a mark, so nothing stands in front of its first chunk
            real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            flat, of = flat.filter(pa.array(real)), of[real]
        # One slice, unless a single text is longer than that.
        ranges = [(0, len(flat))] if len(rows) > 1 or not len(flat) else _parts(pc.binary_length(flat).to_numpy(zero_copy_only=False), size)
        for part, (first, last) in enumerate(ranges):
            yield Slice(rows, flat.slice(first, last - first), of[first:last], part, len(ranges))
        # A worker that waits for its next task keeps no memory of this slice.
        del rows, texts, lists, flat, of
        pa.default_memory_pool().release_unused()


def _squeeze(*parts: bytes) -> bytes:
    return pa.compress(b"".join(parts), "zstd", asbytes=True)


def _spread(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


def asked(named: DataFrame, model, text: str, size: int, buckets: int) -> DataFrame:
    """``slice, bucket, count, size, chunks``: what each slice asks each bucket for, in the order of its places."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, model.value, text, size):
            rows = [(own.name, bucket, n, len(packed), _squeeze(packed)) for bucket, n, packed in own.dealt(buckets)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "bucket", "count", "size", "chunks"]
            )

    return named.mapInArrow(requests, "slice binary, bucket long, count long, size long, chunks binary")


def _unpack_lengths(data: bytes, count: int) -> tuple[np.ndarray, int]:
    lengths = _unpack(data, count)
    used, left = count, lengths >> 7
    while left.any():
        used, left = used + int((left > 0).sum()), left >> 7
    return lengths, used


def answered(requests: DataFrame, model) -> DataFrame:
    """``slice, bucket, count, size, ids``: each request with the ids of its chunks; a bucket's distinct chunks are segmented once."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, at = model.value, {}, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] != at or len(table) > TABLE:
                    table, at = {}, row["bucket"]
                data = _spread(row["chunks"], row["size"])
                lengths, begin = _unpack_lengths(data, row["count"])
                ends = (np.cumsum(lengths) + begin).tolist()
                chunks = [data[a:b] for a, b in zip([begin, *ends[:-1]], ends, strict=True)]
                new = [c for c in dict.fromkeys(chunks) if c not in table]
                table.update(zip(new, (array("I", ids).tobytes() for ids in own.segment([c.decode() for c in new])), strict=True))
                found = [table[c] for c in chunks]
                # Numbers of ids, then the ids with all low bytes first.
                many = np.fromiter(map(len, found), np.int64, len(found)) // 4
                planes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 4).T.tobytes()
                packed = _pack(many) + planes
                rows.append((row["slice"], row["bucket"], row["count"], len(packed), _squeeze(packed)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "bucket", "count", "size", "ids"]
            )

    together = requests.repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(answers, "slice binary, bucket long, count long, size long, ids binary")


def placed(named: DataFrame, model, text: str, size: int, buckets: int) -> DataFrame:
    """The other columns of each row, ``__part``, ``__parts``, ``__slice``, and its chunks as places; the slice's first row has the places' buckets."""
    kept = [f for f in named.schema if f.name != text]
    schema = ST.StructType([
        *kept, ST.StructField("__part", ST.LongType()), ST.StructField("__parts", ST.LongType()), ST.StructField("__slice", ST.BinaryType()),
        ST.StructField("__count", ST.LongType()), ST.StructField("__places", ST.BinaryType()),
        ST.StructField("__chunks", ST.LongType()), ST.StructField("__buckets", ST.BinaryType()),
    ])
    names = [f.name for f in kept]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, model.value, text, size):
            n = len(own.rows)
            columns = {
                "__part": pa.array([own.part] * n, pa.int64()), "__parts": pa.array([own.parts] * n, pa.int64()),
                "__slice": pa.array([own.name] * n, pa.binary()), "__count": pa.array(np.diff(own.bounds), pa.int64()),
                "__places": pa.array([_pack(own.places[a:b]) for a, b in zip(own.bounds[:-1], own.bounds[1:], strict=True)], pa.binary()),
                "__chunks": pa.array([own.n, *[None] * (n - 1)], pa.int64()),
                "__buckets": pa.array([_squeeze(own.buckets(buckets).tobytes()), *[None] * (n - 1)], pa.binary()),
            }
            table = pa.table([*own.rows.select(names).columns, *columns.values()], [*names, *columns])
            yield from table.combine_chunks().to_batches()

    return named.mapInArrow(places, schema)


def _join_back(key: tuple, parts: pa.Table, answers: pa.Table) -> pa.Table:
    """Ids of a slice's rows: those of their chunks, one after the other."""
    names = [c for c in parts.column_names if not c.startswith("__") or c in ("__row", "__part", "__parts")]
    if not len(parts):  # a slice of the other kind, or one that was read differently before
        return parts.select(names).append_column("ids", pa.array([], pa.list_(pa.int32())))
    first = pc.drop_null(parts.column("__buckets"))[0].as_py()
    total = pc.drop_null(parts.column("__chunks"))[0].as_py()
    buckets = np.frombuffer(_spread(first, 2 * total), np.uint16)
    order = np.argsort(buckets, kind="stable")
    ends = np.cumsum(np.bincount(buckets, minlength=1))
    # The ids of all chunks bucket after bucket, and at which of these each place is.
    many, values, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for answer in answers.to_pylist():
        data = _spread(answer["ids"], answer["size"])
        lengths, used = _unpack_lengths(data, answer["count"])
        ids = np.frombuffer(data, np.uint8, offset=used).reshape(4, -1).T
        many.append(lengths)
        values.append(np.ascontiguousarray(ids).view(np.int32).ravel())
        at.append(order[ends[answer["bucket"] - 1] if answer["bucket"] else 0:ends[answer["bucket"]]])
    where = np.full(total, -1, np.int64)
    found = np.concatenate(at)
    where[found] = np.arange(len(found))
    if len(found) != total or (where < 0).any():
        raise RuntimeError("a slice was read differently the second time; give docs as a table or checkpointed")
    table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(many))])), pa.array(np.concatenate(values)))
    counts = parts.column("__count").to_numpy()
    places = [_unpack(packed, n) for packed, n in zip(parts.column("__places").to_pylist(), counts.tolist(), strict=True)]
    ids = table.take(pa.array(where[np.concatenate(places)]))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    offsets = ids.offsets.to_numpy()[bounds] if len(ids) else bounds
    lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), ids.flatten())
    del ids, table, values, many, places
    pa.default_memory_pool().release_unused()
    return parts.select(names).append_column("ids", lists)


def encode(docs: DataFrame, model, text: str = "text", size: int = SLICE, buckets: int | None = None) -> DataFrame:
    """Every row with ``ids``, the ids of its whole text as the library gives them, in the place of the text.

    ``buckets``: of the table of distinct chunks; four for each shuffle partition by default, at least 64 and at most 16,384.
    """
    buckets = buckets or min(max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 16_384)
    named = docs.drop("ids").withColumn("__row", F.monotonically_increasing_id())
    others = [c for c in docs.columns if c not in (text, "ids")]
    answers = answered(asked(named, model, text, size, buckets), model)
    rows = placed(named, model, text, size, buckets)
    kept = ST.StructType([f for f in rows.schema if f.name in {*others, "__row", "__part", "__parts"}]).add("ids", ST.ArrayType(ST.IntegerType()))
    joined = rows.groupBy("__slice").cogroup(answers.groupBy("slice")).applyInArrow(_join_back, kept)
    if docs.filter(F.octet_length(text) >= size).isEmpty():
        return joined.select(*others, "ids")
    # Parts of the texts longer than a slice meet; all other texts are whole as they are.
    joined = materialise(joined, "ids")
    in_order = F.array_sort(F.collect_list(F.struct("__part", "ids")))
    long = joined.filter("__parts > 1").groupBy("__row")
    put = long.agg(*[F.first(c).alias(c) for c in others], F.flatten(in_order["ids"]).alias("ids"))
    return joined.filter("__parts = 1").select(*others, "ids").unionByName(put.select(*others, "ids"))


def decode(encoded: DataFrame, model, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Every row with ``decoded``: the text that the library gives for its ids.  Null ids decode to the empty text."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        # One text's ids at a time become Python numbers.
        own = model.value.own
        pa.default_memory_pool().release_unused()
        return pa.array([own.decode(x.values.to_numpy().tolist()) if x.is_valid and len(x) else "" for x in lists], pa.string())

    return encoded.withColumn(output, decoded(ids))
