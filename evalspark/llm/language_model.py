"""A hierarchical Pitman-Yor language model of words, trained by Gibbs sampling and used to score texts.

Restaurants: one for all words, 64 for the way the word before ends (or none), and one for each different word before, as many as the texts have.  Each
one's parent is the restaurant of the shorter context, and the parent of all is the uniform distribution over the known words and
one unknown word.  A customer of a restaurant sits at a table that serves its word; each table is a customer of the parent.  Words are
known by 64-bit digests, words before by 48 bits of them and how they end.

Counts live in buckets by word, so one word's seating in all restaurants is in one place and parents need no messages; between
buckets only the restaurants' totals are shared, and they are brought up to date after each round of sweeps (parallel Gibbs).  Those of the
first 65 restaurants go through the driver.  Those of the words before are added up in shards by context, and each bucket gets them for the contexts it has.  A
sweep draws the number of tables of each word in each restaurant from its conditional: Stirling numbers for up to 64 customers, further
customers in doubling groups.  Draws are seeded by bucket and sweep, so a round is repeated from the counts instead of kept: nothing
but totals and counts is stored, and a lost executor's bucket comes out the same again.  Predictive probabilities are averaged
over the samples after the first rounds.

Tokens travel to their word's bucket and come back as sums per text.  Words of at least a thousandth of all tokens (at most a thousand words) are dealt by
word and context instead: their buckets hand on the probability of every pair that some text has.  Pairs of at least a thousandth of all tokens are scored where the
text is.  In training the counts of words that are common in a slice are merged by salt before they reach their bucket.

Cases: null and empty texts are one end token; repeated rows are rows of their own; with no text to learn from all words are unknown
and score the uniform probability; an empty table gives an empty table; columns other than the id, the text and the mark of what to learn from are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.near_dedup import word_hashes
from evalspark.llm.repeats import numbered
from evalspark.session import free, materialise, release

ENDS = 64
#: Bits of the digest of a word before; the way it ends stands above them.
BITS = np.uint64(48)
#: Rounds of totals, sweeps in each, and samples that are averaged (the last sweeps).
ROUNDS, SWEEPS, SAMPLES = 2, 2, 2
STRENGTH = 1.0
#: Share of all tokens from which on a word is dealt with its context, and a pair is scored where the text is; the share of a slice from which on counts are salted.
COMMON, SALTED, SALTS = 0.001, 0.0005, 16
EXACT = 64
#: Texts handled at a time, at most 65,536.
SLICE = 2000
#: Texts whose words are hashed at a time, which takes some 40 bytes a character.
PIECE = 250
END = np.uint64(0xE7D)

_KINDS = np.array([50 + b % 13 for b in range(256)], np.int64)
_KINDS[97:123] = np.arange(1, 27)
_KINDS[48:58] = 27
for _number, _mark in enumerate(b".,!?;:"):
    _KINDS[_mark] = 28 + _number
_KINDS[128:] = 34 + np.arange(128) % 16
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Places of the common words in a pair's number.
_NAMES = np.uint64(10)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and text number of every token: the words of each text and its end."""
    words, counts, last = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(text), END, np.uint64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    out[inside] = words
    context = np.zeros(len(text), np.uint64)
    context[np.flatnonzero(inside) + 1] = (_KINDS[last].astype(np.uint64) << BITS) | (words >> np.uint64(16))
    return out, context, text


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers byte by byte, compressed; ``rising`` ones by their differences."""
    values = np.asarray(values).astype(np.uint64)
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not values.max(initial=0) >> np.uint64(8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(7, "little") + bytes([width]) + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def _unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7]
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(_ZSTD.decompress(data[8:], width * n, asbytes=True), np.uint8).reshape(width, n)
    values = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _runs(values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted values as the different ones and how often each stands."""
    first = _firsts(values)
    return _pack(values[first], rising=True), _pack(np.diff(np.append(first, len(values))))


def _repeated(values: bytes, times: bytes) -> np.ndarray:
    return np.repeat(_unpack(values, rising=True), _unpack(times).astype(np.int64))


def _packed(words: np.ndarray, contexts: np.ndarray, *values: np.ndarray) -> tuple[bytes, ...]:
    """Sorted words, different contexts, each token's context among them, and the other columns."""
    keys, at = np.unique(contexts, return_inverse=True)
    return (*_runs(words), _pack(keys, rising=True), _pack(at), *(_pack(v) for v in values))


def _contexts(row) -> np.ndarray:
    return _unpack(row.contexts, rising=True)[_unpack(row.at).astype(np.int64)]


def _summed(words: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs sorted by word and context, each once, with their counts."""
    (words, word), (keys, at) = np.unique(words, return_inverse=True), np.unique(contexts, return_inverse=True)
    pairs = word * max(len(keys), 1) + at
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = _firsts(pairs)
    return words[pairs[first] // max(len(keys), 1)], keys[pairs[first] % max(len(keys), 1)], np.add.reduceat(n, first) if len(first) else n


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def _ranked(texts: list[str | None], buckets: int) -> tuple[np.ndarray, ...]:
    """Different words of a slice by bucket and digest, where each bucket begins, the words of tokens among them; different contexts, those of tokens; texts of tokens."""
    parts = [tokens(texts[i:i + PIECE]) for i in range(0, len(texts), PIECE)]
    contexts, text = np.concatenate([c for _, c, _ in parts]), np.concatenate([t + i * PIECE for i, (_, _, t) in enumerate(parts)])
    words, word = np.unique(np.concatenate([w for w, _, _ in parts]), return_inverse=True)
    bucket = _bucket(words, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    word = rank[word]
    # A context is known by the word before it, the first one is of none.
    before = np.zeros(len(word), np.int64)
    before[1:] = np.where(contexts[1:] == 0, 0, word[:-1] + 1)
    keys = np.zeros(len(words) + 1, np.uint64)
    keys[before] = contexts
    return words[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), word, keys, before, text


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], list(schema))


BLOB = "bucket int, salt int, words binary, times binary, contexts binary, at binary, n binary"
_BLOB = dict(zip(["bucket", "salt", "words", "times", "contexts", "at", "n"], [pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True))


def _counted(buckets: int):
    """Pairs of each slice with the tokens to learn from, none for other texts; words that are common in the slice in rows of their own, with a salt."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                number += 1
                part = batch.slice(begin, SLICE)
                words, edges, word, keys, before, text = _ranked(part.column("body").to_pylist(), buckets)
                learn = part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)[text]
                common = np.bincount(word, weights=learn, minlength=len(words)) >= SALTED * len(word)
                # Sorted by bucket, word and context; the last bit tells whether the token is learned.
                pairs = np.sort((word * len(keys) + before) << 1 | learn)
                first = _firsts(pairs >> 1)
                n = np.add.reduceat(pairs & 1, first) if len(first) else pairs
                word, before = np.divmod(pairs[first] >> 1, len(keys))
                cuts, rows = np.searchsorted(word, edges), []
                for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for salt, own in ((-1, ~common), (number % SALTS, common)):
                        own = x + np.flatnonzero(own[word[x:y]])
                        if len(own):
                            rows.append((b, salt, *_packed(words[word[own]], keys[before[own]], n[own])))
                if rows:
                    yield _batch(rows, _BLOB)

    return counted


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    rows = list(frame.itertuples())
    words = np.concatenate([_repeated(r.words, r.times) for r in rows])
    contexts = np.concatenate([_contexts(r) for r in rows])
    words, contexts, n = _summed(words, contexts, np.concatenate([_unpack(r.n).astype(np.int64) for r in rows]))
    return pd.DataFrame([(rows[0].bucket, -1, *_packed(words, contexts, n))], columns=list(_BLOB))


def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: ways to seat n customers at t tables."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    for n in range(EXACT):
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore"):
            table[n + 1, 1:] = np.logaddexp(table[n, :-1], table[n, 1:] + np.log(np.maximum(n - t * discount, 0.0)))
    return table


class Weights(dict):
    """What the restaurant of a word before leaves to its parent: that of no word before; a word that nobody follows leaves all."""

    def __missing__(self, context) -> float:
        return 1.0


class Totals:
    """One round's customers and tables of the restaurants (of words before: of none, and of all others together), sizes of the training text, discounts."""

    def __init__(self, number: int, tokens: int, words: int, customers: list[np.ndarray], tables: list[np.ndarray], discounts: list[float]):
        self.number, self.tokens, self.words, self.customers, self.tables, self.discounts = number, tokens, words, customers, tables, discounts
        self.base = 1.0 / (words + 1)

    def weight(self, level: int) -> np.ndarray | Weights:
        """What each restaurant of a level leaves to its parent."""
        weights = self.left(level, self.customers[level], self.tables[level])
        return weights if level < 2 else Weights({0: float(weights[0])})

    def left(self, level: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discounts[level] * tables) / (STRENGTH + customers)


class Seating:
    """One bucket's words in all restaurants.

    ``keys`` are all words before that the bucket meets, also in texts that are not learned from; their totals, where the row has them, are for all buckets.
    """

    def __init__(self, row, seed: int):
        words, at, n = _repeated(row.words, row.times), _unpack(row.at).astype(np.int64), _unpack(row.n).astype(np.int64)
        self.keys = _unpack(row.contexts, rising=True)
        self.kinds = (self.keys >> BITS).astype(np.int64)
        self.asked, self.asked_at = words, at
        learned = n > 0
        self.words, self.at = words[learned], at[learned]
        self.contexts = self.keys[self.at]
        self.n = [None, None, n[learned]]
        self.vocabulary, self.word = np.unique(self.words, return_inverse=True)
        self.pair1, self.up1 = np.unique(self.word * ENDS + self.kinds[self.at], return_inverse=True)
        self.word1, self.context1 = self.pair1 // ENDS, self.pair1 % ENDS
        self.pairs = self.word * max(len(self.keys), 1) + self.at
        self.count = np.bincount(self.word, weights=self.n[2], minlength=len(self.vocabulary)).astype(np.int64)
        self.t = [np.ones(len(self.vocabulary), np.int64), np.ones(len(self.pair1), np.int64), np.ones(len(self.words), np.int64)]
        self.seed = seed
        self.customers, self.tables = None, []
        if getattr(row, "customers", None) is not None:
            # Totals come shard by shard.
            place = np.argsort(_shard(self.keys, row.shards), kind="stable")
            in_order = lambda packed: np.concatenate([_unpack(x) for x in packed]).astype(float)[np.argsort(place)]
            self.customers = in_order(row.customers)
            while getattr(row, f"tables{len(self.tables)}", None) is not None:
                self.tables.append(in_order(getattr(row, f"tables{len(self.tables)}")))
        self._up()

    def _up(self):
        self.n[1] = np.bincount(self.up1, weights=self.t[2], minlength=len(self.pair1)).astype(np.int64)
        self.n[0] = np.bincount(self.word1, weights=self.t[1], minlength=len(self.vocabulary)).astype(np.int64)
        self.t[1], self.t[0] = np.minimum(self.t[1], self.n[1]), np.minimum(self.t[0], self.n[0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables that this bucket's words have in the restaurant of each word before."""
        return tuple(np.bincount(self.at, weights=x[2], minlength=len(self.keys)).astype(np.int64) for x in (self.n, self.t))

    def weights(self, totals: Totals) -> np.ndarray:
        """What the restaurant of each of the keys leaves to its parent."""
        return totals.left(2, self.customers, self.tables[totals.number])

    def probabilities(self, totals: Totals) -> list[np.ndarray]:
        """Predictive probability of each word, and of each pair in its contexts."""
        out = []
        every = np.zeros(len(self.vocabulary), np.int64)
        for level, customers, weight, above in (
            (0, totals.customers[0][every], totals.weight(0)[every], None), (1, totals.customers[1][self.context1], totals.weight(1)[self.context1], self.word1),
            (2, self.customers[self.at], self.weights(totals)[self.at], self.up1),
        ):
            parent = totals.base if above is None else out[-1][above]
            out.append(np.maximum(self.n[level] - totals.discounts[level] * self.t[level], 0.0) / (STRENGTH + customers) + weight * parent)
        return out

    def predicted(self, words: np.ndarray, times: np.ndarray, at: np.ndarray, totals: Totals, samples: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probability of words, each as often as ``times`` says, after the keys ``at``, and how often each word was learned."""
        weights, kinds = self.weights(totals)[at], self.kinds[at]
        if not len(self.vocabulary):
            return totals.base * totals.weight(0)[0] * totals.weight(1)[kinds] * weights, np.zeros(len(at))
        word = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == words
        n, known, word = np.repeat(np.where(known, self.count[word], 0), times), np.repeat(known, times), np.repeat(word, times)
        key = word * len(self.keys) + at
        pair = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        whole = known & (self.pairs[pair] == key)
        p = np.zeros(len(at))
        p[whole] = sum(p2[pair[whole]] for _, _, p2 in samples) / len(samples)
        # Pairs that were not learned have what their context leaves to the shorter one.
        rest = np.flatnonzero(~whole)
        known, word, kinds = known[rest], word[rest], kinds[rest]
        key = word * ENDS + kinds
        pair = np.minimum(np.searchsorted(self.pair1, key), len(self.pair1) - 1)
        whole, left = known & (self.pair1[pair] == key), totals.weight(1)[kinds]
        unknown = totals.base * totals.weight(0)[0]
        shorter = sum(np.where(whole, p1[pair], left * np.where(known, p0[word], unknown)) for p0, p1, _ in samples) / len(samples)
        p[rest] = weights[rest] * shorter
        return p, n

    def sweep(self, totals: Totals, number: int, stirling: list[np.ndarray]) -> None:
        """New numbers of tables, from the longest contexts up."""
        draw = np.random.default_rng([self.seed, number])
        p = self.probabilities(totals)
        parents = (np.full(len(self.vocabulary), totals.base), p[0][self.word1], p[1][self.up1])
        tables = (np.repeat(totals.tables[0], len(self.vocabulary)), totals.tables[1][self.context1], self.tables[totals.number][self.at])
        for level in (2, 1, 0):
            others = np.maximum(tables[level] - self.t[level], 0)
            self.t[level] = _tables(self.n[level], parents[level], others, totals.discounts[level], stirling[level], draw)
            if level:
                self._up()

    def sample(self, history: list[Totals], samples: int = 0) -> Iterator[list[np.ndarray]]:
        """All sweeps of the rounds so far; the probabilities after each of the last ones."""
        number, last = 0, len(history) * SWEEPS
        for totals in history:
            stirling = [_log_stirling(d) for d in totals.discounts]
            for _ in range(SWEEPS):
                self.sweep(totals, number, stirling)
                number += 1
                if number > last - samples:
                    yield self.probabilities(totals)


def _tables(n, parent, others, discount, stirling, draw) -> np.ndarray:
    """Tables of a word with n customers, given its probability in the parent and the other words' tables of the restaurant."""
    out = np.ones(len(n), np.int64)
    for size in range(2, EXACT + 1):
        at = np.flatnonzero(n == size) if size < EXACT else np.flatnonzero(n >= size)
        if not len(at):
            continue
        t = np.arange(1, size + 1)
        # Each further table is opened with the strength left for new tables, times the parent's probability.
        opened = np.cumsum(np.log((STRENGTH + discount * (others[at][:, None] + t - 1)) * parent[at][:, None]), axis=1)
        noise = draw.gumbel(size=(len(at), size))
        out[at] = 1 + np.argmax(stirling[size, 1:size + 1] + opened + noise, axis=1)
    many = np.flatnonzero(n > EXACT)
    seated = np.full(len(many), EXACT, np.int64)
    while len(many):
        group = np.minimum(seated, n[many] - seated)
        new = (STRENGTH + discount * (others[many] + out[many])) * parent[many]
        share = new / (new + np.maximum(seated - discount * out[many], 1e-9))
        out[many] += draw.binomial(group, np.minimum(share, 1.0))
        seated += group
        left = seated < n[many]
        many, seated = many[left], seated[left]
    return out


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[Totals], int]:
    """Counts by bucket with the totals of its contexts, the totals of every round, and the number of buckets.

    ``texts``: ``body``, and ``learn`` where not all are learned from; the others' pairs get a count of zero.
    """
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("body", F.col("learn") if "learn" in texts.columns else F.lit(True).alias("learn"))
    merged = materialise(rows.mapInArrow(_counted(buckets), BLOB).groupBy("bucket", "salt").applyInPandas(_merged, BLOB), "merged")
    counts = materialise(merged.groupBy("bucket").applyInPandas(_merged, BLOB), "counts")
    release(merged)
    held, history = counts.drop("salt").withColumn("shards", F.lit(buckets)), []
    for number in range(rounds):
        moves = materialise(held.mapInPandas(_moved(list(history), buckets), MOVE), "moves")
        history.append(_totals(moves, number))
        shares = moves.filter("shard >= 0").groupBy("shard").applyInPandas(_added, SHARE)
        in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("shard", c))), lambda x: x[c])
        sums = [in_order("tables").alias(f"tables{number}"), *([] if number else [in_order("customers").alias("customers")])]
        held = held.join(materialise(shares.groupBy("bucket").agg(*sums), "seats"), "bucket")
        release(moves)
    return held, history, buckets


#: Customers and tables of the restaurants of all words, of endings, and of no word before and all others.
_WIDTHS = (1, ENDS, 2)
#: Groups in which the buckets' sums are added before the driver adds the rest.
GROUPS = 16
#: Sums of a bucket for one shard of the words before; negative shards: its sums for the driver.
MOVE = "shard int, bucket int, keys binary, customers binary, tables binary"
SHARE = "shard int, bucket int, customers binary, tables binary"


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def _sums_of(own: Seating) -> np.ndarray:
    """Tokens, words, and for each level customers, tables, and words seated by one or two customers."""
    parts = [[own.count.sum(), len(own.vocabulary)]]
    for level, where in enumerate((np.zeros(len(own.vocabulary), np.int64), own.context1, (own.contexts != 0).astype(np.int64))):
        parts += [np.bincount(where, weights=x[level], minlength=_WIDTHS[level]) for x in (own.n, own.t)]
        parts.append([(own.n[level] == 1).sum(), (own.n[level] == 2).sum()])
    return np.concatenate(parts).astype(np.int64)


def _moved(history: list[Totals], shards: int):
    """What each bucket's words add to the restaurants after the sweeps so far: a packed row for each shard, and one for the driver."""

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Seating(row, row.bucket)
                for _ in own.sample(history):
                    pass
                customers, tables = own.sums()
                shard = _shard(own.keys, shards)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                out = [(-1 - row.bucket % GROUPS, row.bucket, None, _sums_of(own).tobytes(), None)]
                out += [(s, row.bucket, _pack(own.keys[part], rising=True), _pack(customers[part]), _pack(tables[part])) for s in range(shards) if len(part := order[edges[s]:edges[s + 1]])]
                yield pd.DataFrame(out, columns=["shard", "bucket", "keys", "customers", "tables"])

    return moved


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard's words before, for each bucket those it has, in the order it gave them."""
    keys = [_unpack(x, rising=True) for x in frame["keys"]]
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    out = [[int(b) for b in frame.bucket]]
    for name in ("customers", "tables"):
        values = np.concatenate([_unpack(x) for x in frame[name]]).astype(np.float64)
        sums = np.bincount(place, weights=values, minlength=len(different))
        out.append([_pack(sums[place[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return pd.DataFrame({"shard": int(frame.shard.iloc[0]), "bucket": out[0], "customers": out[1], "tables": out[2]})


def _totals(moves: DataFrame, number: int) -> Totals:
    """A round's totals: one packed row per bucket, added up in groups of buckets; one row per group reaches the driver."""

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(frame.shard.iloc[0]), sum(np.frombuffer(x, np.int64) for x in frame.customers).tobytes())], columns=["part", "sums"])

    rows = moves.filter("shard < 0").groupBy("shard").applyInPandas(added, "part int, sums binary").collect()
    sums = sum((np.frombuffer(r.sums, np.int64) for r in rows), np.zeros(2 + sum(2 * w + 2 for w in _WIDTHS), np.int64))
    customers, tables, discounts, at = [], [], [], 2
    for width in _WIDTHS:
        customers.append(sums[at:at + width].astype(float))
        tables.append(sums[at + width:at + 2 * width].astype(float))
        one, two = (int(x) for x in sums[at + 2 * width:at + 2 * width + 2])
        discounts.append(float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95)))
        at += 2 * width + 2
    return Totals(number, int(sums[0]), int(sums[1]), customers, tables, discounts)


def _common(counts: DataFrame, least: float) -> dict[int, int]:
    """Words of at least a thousandth of all tokens and how often they stand."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                words, n = _repeated(row.words, row.times), _unpack(row.n).astype(np.int64)
                first = _firsts(words)
                count = np.add.reduceat(n, first) if len(first) else n
                chosen = np.flatnonzero((count >= least) & (count > 0))
                yield pd.DataFrame({"word": words[first][chosen].view(np.int64), "n": count[chosen]})

    rows = counts.mapInPandas(found, "word long, n long").toPandas()  # at most 1 / COMMON rows
    return dict(zip(rows["word"].tolist(), rows["n"].tolist(), strict=True))


PAIRS = "bucket int, codes binary, p binary"


def _codes(names: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Numbers of pairs of a common word, by its place, and a word before."""
    return (context << _NAMES) | names.astype(np.uint64)


def _dealt(codes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _common_pairs(history: list[Totals], names: np.ndarray, buckets: int):
    """Logarithms of probability of all pairs of common words that texts have, dealt by pair; those of a thousandth of all tokens in rows of their own (bucket -1)."""
    totals = history[-1]

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Seating(row, row.bucket)
                name = np.minimum(np.searchsorted(names, own.asked), max(len(names) - 1, 0))
                chosen = np.flatnonzero(names[name] == own.asked) if len(names) else name[:0]
                out = []
                if len(chosen):
                    n = _unpack(row.n)[chosen]
                    words = own.asked[chosen]
                    p, _ = own.predicted(words, np.ones(len(words), np.int64), own.asked_at[chosen], totals, list(own.sample(history, SAMPLES)))
                    codes = _codes(name[chosen], own.keys[own.asked_at[chosen]])
                    bucket = np.where(n >= max(COMMON * totals.tokens, 1), -1, _dealt(codes, buckets))
                    order = np.lexsort((codes, bucket))
                    edges = np.searchsorted(bucket[order], np.arange(-1, buckets + 1))
                    out = [(b - 1, _pack(codes[part], rising=True), np.log10(p[part]).astype(np.float32).tobytes()) for b in range(buckets + 1) if len(part := order[edges[b]:edges[b + 1]])]
                yield pd.DataFrame(out, columns=["bucket", "codes", "p"])

    return found


def _sorted_pairs(rows) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r.codes, rising=True) for r in rows)])
    p = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r.p, np.float32) for r in rows)]).astype(float)
    order = np.argsort(codes)
    return codes[order], p[order]


_REQUEST = dict(zip(
    ["bucket", "slice", "common", "words", "times", "contexts", "at", "texts", "rows", "sums"], [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 7], strict=True))
REQUEST = "bucket int, slice long, common boolean, words binary, times binary, contexts binary, at binary, texts binary, rows binary, sums binary"


def _asked(buckets: int, common):
    """Sums of what is known of each text here, and requests for the probabilities of its tokens."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, near, near_p = common.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                part = batch.slice(begin, SLICE)
                rows = part.column("row").to_numpy()
                words, edges, word, keys, before, text = _ranked(part.column("body").to_pylist(), buckets)
                at = np.minimum(np.searchsorted(names, words), max(len(names) - 1, 0))
                common_word = names[at] == words if len(names) else np.zeros(len(words), bool)
                hit = np.flatnonzero(common_word[word])
                codes = _codes(at[word[hit]], keys[before[hit]])
                place = np.minimum(np.searchsorted(near, codes), max(len(near) - 1, 0))
                here = near[place] == codes if len(near) else np.zeros(len(codes), bool)
                add = lambda x, of: np.bincount(text[of], weights=x, minlength=len(rows))
                sums = np.stack([
                    np.bincount(text, minlength=len(rows)), add(np.ones(len(hit)), hit), add(np.log10(n[at[word[hit]]] + 1), hit),
                    add(near_p[place[here]], hit[here]),
                ]).astype(np.float64)
                # Negative buckets only hand their sums on.
                out = [(-1 - number % buckets, number, False, None, None, None, None, None, rows.tobytes(), sums.tobytes())]
                hit, codes = hit[~here], codes[~here]
                bucket = _dealt(codes, buckets)
                order = np.argsort(codes)
                order = order[np.argsort(bucket[order].astype(np.uint16) if buckets < 1 << 16 else bucket[order], kind="stable")]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    if len(some := order[cuts[b]:cuts[b + 1]]):
                        out.append((b, number, True, *_runs(codes[some]), None, None, _pack(text[hit[some]]), None, None))
                # Sorted by bucket, word and text, which takes the fewest bytes.
                own = ~common_word[word]
                each = np.sort((word[own] << 16 | text[own]) * len(keys) + before[own])
                word, before = np.divmod(each, len(keys))
                word, text = word >> 16, word & 0xFFFF
                cuts = np.searchsorted(word, edges)
                for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if x < y:
                        out.append((b, number, False, *_packed(words[word[x:y]], keys[before[x:y]], text[x:y]), None, None))
                number += 1
                yield _batch(out, _REQUEST)

    return asked


ANSWER = "slice long, rows binary, texts binary, sums binary"
SUMS = ["row", "n_tokens", "n_known", "base", "score"]


def _answered(history: list[Totals]):
    def answered(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        answers, totals = [], history[-1]
        rows = list(held.itertuples())
        common, common_p = _sorted_pairs([r for r in rows if r.codes is not None])
        counts = [r for r in rows if r.codes is None]
        own = Seating(counts[0], int(counts[0].bucket)) if counts else None
        samples = None
        for ask in asks.itertuples():
            if ask.sums is not None:
                answers.append((ask.slice, ask.rows, None, ask.sums))
                continue
            texts = _unpack(ask.texts).astype(np.int64)
            words, times = _unpack(ask.words, rising=True), _unpack(ask.times).astype(np.int64)
            if ask.common:
                p = np.repeat(common_p[np.searchsorted(common, words)], times)
            else:
                if samples is None:
                    samples = list(own.sample(history, SAMPLES))
                # Every context that is asked for is one of the bucket's keys.
                at = np.searchsorted(own.keys, _unpack(ask.contexts, rising=True))[_unpack(ask.at).astype(np.int64)]
                p, n = own.predicted(words, times, at, totals, samples)
            here, text = np.unique(texts, return_inverse=True)
            values = (p,) if ask.common else (np.log10(n + 1), np.log10(p))
            known = b"" if ask.common else _pack(np.bincount(text, weights=n > 0))
            answers.append((ask.slice, known, _pack(here, rising=True), np.stack([np.bincount(text, weights=x) for x in values]).tobytes()))
        # One row per slice of texts and bucket, two where it has common words; for rows the number of known tokens.
        return pd.DataFrame(answers, columns=["slice", "rows", "texts", "sums"])

    return answered


def _together(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of one slice's texts from what each bucket answered."""
    own = frame[frame.texts.isna()].iloc[0]
    sums = np.frombuffer(own.sums, np.float64).reshape(4, -1).copy()
    for answer in frame[frame.texts.notna()].itertuples():
        texts = _unpack(answer.texts, rising=True).astype(np.int64)
        values = np.frombuffer(answer.sums, np.float64).reshape(-1, len(texts))
        sums[-len(values):, texts] += values
        if answer.rows:
            sums[1, texts] += _unpack(answer.rows)
    return pd.DataFrame({"row": np.frombuffer(own.rows, np.int64), **dict(zip(SUMS[1:], sums, strict=True))})


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``<key>, n_tokens, n_known, train_tokens, base_score, score`` of every row; the model learns from rows where ``learn`` is true.

    ``base_score`` is the text's log10 probability under counts of words plus one, ``score`` under the model.
    """
    rows = numbered(docs, key, text)
    counts, history, buckets = train(rows.withColumn("learn", F.coalesce(learn, F.lit(False))).select("body", "learn"), rounds)
    totals = history[-1]
    known = _common(counts.select("words", "times", "n"), COMMON * totals.tokens)
    names = np.sort(np.array(list(known), np.int64).view(np.uint64))
    n = np.array([known[int(w)] for w in names.view(np.int64)], np.float64)
    pairs = materialise(counts.mapInPandas(_common_pairs(history, names, buckets), PAIRS), "pairs")
    free(docs.sparkSession)
    near = _sorted_pairs(pairs.filter("bucket < 0").collect())  # at most 1 / COMMON pairs
    common = docs.sparkSession.sparkContext.broadcast((names, n, *near))
    asks = rows.select("row", "body").mapInArrow(_asked(buckets, common), REQUEST)
    held = counts.unionByName(pairs.filter("bucket >= 0"), allowMissingColumns=True)
    parts = asks.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(_answered(history), ANSWER)
    sums = parts.groupBy("slice").applyInPandas(_together, "row long, n_tokens double, n_known double, base double, score double")
    all_ways = float(np.log10(totals.tokens + totals.words + 1))
    return rows.select("row", key).join(sums, "row").select(
        key, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * all_ways).alias("base_score"), "score",
    )
