"""Token counts through a cache of digests.

The cache is a Parquet table ``digest, tokenizer, n_tokens``.  Contents are normalised as the tokenizer does it (null is the
empty text; this vocabulary keeps everything else as it is, so equal normal forms have equal counts), digested, and joined to
the stored counts of the same tokenizer version.  One row of each digest that is missing is encoded, and the new counts are
appended.  Only digests and ids move for looking up; a text moves once, if it is the one that stands for its digest.

Encoding: no piece of such a vocabulary has a word mark after another character (checked when it is loaded), so no merge
crosses from a word to the next word mark.  A text's count is therefore the sum over its words with the marks in front, and each
distinct word is encoded once per batch.  Vocabularies for which that does not hold are given whole texts.

Cases: null and empty texts have no bytes and no tokens; repeated rows each get their row; an empty table gives an empty table;
columns of other names pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import new_table_path

MARK = "▁"
#: Words kept in a worker's memory between batches.
WORDS_KEPT = 300_000
TEXTS_AT_ONCE = 1_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


class Pieces:
    """A sentencepiece model, loaded in each worker from the file's bytes."""

    def __init__(self, data: bytes):
        self.data, self._own, self._words = data, None, {}
        #: Version of the tokenizer: counts of another model or library are never taken for this one's.
        import sentencepiece

        self.version = hashlib.sha256(data + sentencepiece.__version__.encode()).hexdigest()

    def __getstate__(self):
        return {"data": self.data, "version": self.version, "_own": None, "_words": {}}

    @property
    def own(self):
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            pieces = (self._own.id_to_piece(i) for i in range(self._own.get_piece_size()))
            kept = "".join(self._own.encode("a  ﬁ b ", out_type=str)) == f"{MARK}a{MARK * 2}ﬁ{MARK}b{MARK}"
            self.by_word = kept and not any(MARK in piece.lstrip(MARK) for piece in pieces)
        return self._own

    def count(self, texts: list[str]) -> list[int]:
        own = self.own
        if not self.by_word:
            return [len(x) for x in own.encode(texts, num_threads=1)]
        counts = []
        for begin in range(0, len(texts), TEXTS_AT_ONCE):
            lists = [self._split(text) for text in texts[begin:begin + TEXTS_AT_ONCE]]
            self._learn(set().union(*lists))
            counts += [sum(map(self._words.__getitem__, words)) for words in lists]
        return counts

    @staticmethod
    def _split(text: str) -> list[str]:
        """Words with the marks in front of them but one: the library itself puts one mark in front of what it is given."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [word[1:] for word in re.findall(" +[^ ]*", " " + text)]

    def _learn(self, words: set[str]) -> None:
        """Counts of all these words, those not yet known in one call of the library."""
        known = self._words
        if len(known) > WORDS_KEPT:
            known.clear()
        missing = list(words - known.keys())
        if "" in words:  # a mark at the end with nothing after it
            missing = [w for w in missing if w]
            known[""] = len(self._own.encode("a ")) - len(self._own.encode("a"))
        if missing:
            known.update(zip(missing, map(len, self._own.encode(missing, num_threads=1)), strict=True))


def load(spark: SparkSession, path: str | None = None):
    """The model as a broadcast; its size is that of one file and does not grow with the data."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return spark.sparkContext.broadcast(Pieces(file.read()))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; none where the cache has not been begun."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    # A job that was repeated may have stored a digest twice, with the same count.
    return table.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model, text: str = "text", cache: str | None = None) -> DataFrame:
    """Every row with ``n_bytes`` and ``n_tokens`` of its whole text.

    ``cache``: folder of the stored counts, to be used again by later calls; a new one in the shared folder by default.
    Tokens of texts whose digest it lacks are counted and appended when this function is called.
    """
    spark, version = docs.sparkSession, model.value.version
    cache = cache or new_table_path(spark, "token-counts")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            counts = own.count(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    # One text of each digest, chosen where it is read; the shuffle by digest below drops those of other tasks.
    contents = docs.select(digest.alias("digest"), body.alias("body"))
    missing = contents.join(stored(spark, cache, version).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    fresh = missing.mapInArrow(counted, "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    named = docs.drop("n_bytes", "n_tokens").withColumn("__digest", digest).withColumn("n_bytes", F.octet_length(body).cast("long"))
    counts = stored(spark, cache, version).withColumnRenamed("digest", "__digest")
    return named.join(counts, "__digest", "left").drop("__digest")
