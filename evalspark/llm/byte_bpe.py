"""Byte-level BPE with overlapping chunks.

A text is cut into chunks that overlap.  Every chunk is pre-tokenised on its own, starting at a place that need not be a
pre-token boundary.  Pre-tokenising only ever looks forward, so from the first boundary that two neighbouring chunks share in
their overlap on, both agree; the text may be cut there.  Chunks without a shared boundary (one pre-token longer than the
overlap) stay joined to the chunk in front.  The pieces between cuts are encoded apart, and their ids are joined.

Texts of one chunk need no stitching and are encoded where they are read.  Longer ones are spread over tasks by chunk.

Cases: null counts as the empty text, which has no ids and decodes to no bytes; repeated rows stay; an empty table gives an
empty table; columns of other names pass through, a column named like an output is replaced.
"""

from __future__ import annotations

import base64
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import materialise

#: Characters of a chunk, and by how many each chunk reaches into the next one.
CHUNK, OVERLAP = 32_768, 2_048


class Vocabulary:
    """Ranks of a tiktoken file, loaded in each worker from the file's bytes; a few hundred kB, whatever the corpus."""

    def __init__(self, data: bytes, pattern: str = public_tokenizers.PATTERN):
        self.data, self.pattern, self._encoding, self._bytes = data, pattern, None, None

    def __getstate__(self):
        return {"data": self.data, "pattern": self.pattern, "_encoding": None, "_bytes": None}

    def _ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.data.splitlines()) if token}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self._ranks(), special_tokens={})
        return self._encoding

    @property
    def token_bytes(self) -> dict[int, bytes]:
        if self._bytes is None:
            self._bytes = {rank: token for token, rank in self._ranks().items()}
        return self._bytes

    def ids(self, text: str):
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def join(self, ids: list[int]) -> bytes:
        if not ids:
            return b""
        found = itemgetter(*ids)(self.token_bytes)
        return found if len(ids) == 1 else b"".join(found)


def load(spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
    """The vocabulary as a broadcast; its size is that of one file and does not grow with the data."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return spark.sparkContext.broadcast(Vocabulary(file.read(), pattern))


def _encoder(vocabulary):
    @F.arrow_udf("array<int>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        import numpy as np

        own = vocabulary.value
        found = [own.ids(text.as_py() or "") for text in texts]
        offsets = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        values = np.concatenate([*found, np.zeros(0, np.uint32)]).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return encode_texts


def _edges(vocabulary):
    """Pre-token starts in a chunk's head and in what it shares with the next chunk, counted from that next chunk's start."""

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def edges(chunks: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
        import regex

        pattern = regex.compile(vocabulary.value.pattern)
        rows = []
        for chunk, size, overlap in zip(chunks.to_pylist(), sizes.to_pylist(), overlaps.to_pylist(), strict=True):
            starts = [m.start() for m in pattern.finditer(chunk)]
            rows.append({"head": [s for s in starts if s < overlap], "tail": [s - size for s in starts if s >= size]})
        return pa.array(rows, pa.struct([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    return edges


def stitched_pieces(docs: DataFrame, vocabulary, key: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, piece, piece_text``: pieces that can be encoded apart; joined in order they are the text.  ``key`` must be unique."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(chunk)).cast("int") - 1, F.lit(0))
    chunks = docs.select(F.col(key), F.col(text), F.explode(F.sequence(F.lit(0), last)).alias("part")).select(
        key, "part", F.substring(F.col(text), F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("body")
    )
    found = chunks.withColumn("edges", _edges(vocabulary)("body", F.lit(chunk), F.lit(overlap)))
    in_order = Window.partitionBy(key).orderBy("part")
    shared = F.array_min(F.array_intersect("edges.head", F.lag("edges.tail").over(in_order)))
    cut = found.withColumn("cut", F.when(F.col("part") == 0, F.lit(0)).otherwise(shared)).drop("edges")
    piece = F.sum(F.col("cut").isNotNull().cast("int")).over(in_order)
    begin = F.coalesce("cut", F.lit(0))
    end = F.lit(chunk) + F.coalesce(F.lead("cut").over(in_order), F.lit(0))
    parts = cut.select(key, "part", piece.alias("piece"), F.substring(F.col("body"), begin + 1, end - begin).alias("own"))
    joined = F.array_sort(F.collect_list(F.struct("part", "own")))
    return parts.groupBy(key, "piece").agg(F.array_join(joined["own"], "").alias("piece_text"))


def encode(docs: DataFrame, vocabulary, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row with ``ids``, the token ids of its whole text."""
    docs, encoder = docs.drop("ids"), _encoder(vocabulary)
    body = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(body) > chunk
    short = docs.filter(~is_long).withColumn("ids", encoder(body))
    # A row number that is fixed by writing it: texts of more than one chunk are put together again by it.
    numbered = materialise(docs.filter(is_long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    pieces = stitched_pieces(numbered, vocabulary, "__row", text, chunk, overlap).withColumn("ids", encoder("piece_text"))
    joined = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    whole = pieces.groupBy("__row").agg(F.flatten(joined["ids"]).alias("ids"))
    return short.unionByName(numbered.join(whole, "__row").drop("__row"))


def decode(encoded: DataFrame, vocabulary, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Every row with ``decoded``: the raw bytes of its ids, one after the other.  Null ids decode to no bytes."""

    @F.arrow_udf("binary")
    def decode_ids(lists: pa.Array) -> pa.Array:
        # One text's ids at a time become Python numbers.
        own = vocabulary.value
        return pa.array([own.join(x.values.to_pylist() if x.is_valid else []) for x in lists], pa.binary())

    return encoded.withColumn(output, decode_ids(ids))
