"""Runs of words that repeat with a period, found by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) whose length is at least
``max(shortest, repeats * q)`` and which no neighbouring word extends.  Every word of a run therefore occurs ``repeats`` times or
more in it: a word that is rarer than that in a segment lies in no run of the segment and splits it.  What is left is counted
anew, piece by piece, until no piece loses a word; pieces shorter than a run are dropped.  Ordinary prose is gone after a few rounds.

Surviving pieces are scanned for lags.  Not every lag is tried: in a run of period q every string of k >= q words recurs after
exactly q words and no sooner, so for k = 8, 16, 32, ... the distance of each string of k words to the same string before it is
the lag, and a stretch of equal distances d <= k is a run of period d, whole.
Runs of a period over k / 2 are long enough for that, as their period fits into them three times.  Strings of 2k words get their names from pairs
of names of k words, so a piece of n words costs about n log n whatever its periods are, also with a vocabulary of two words.

A text is worked on where it is read; there is no shuffle.  A batch is cut into slices of about ``SLICE`` bytes, whose words are numbered once.

Cases: a null or empty text has no words, no runs and an empty rest; repeated rows each get their row; an empty table gives an
empty table; columns of other names pass through, columns named like an output are replaced.  Two runs may overlap; a word of both
is dropped if either drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, and how often its period must fit into it.
SHORTEST, REPEATS = 24, 3
#: Bytes of text that are split into words at a time; a longer text is a slice of its own.
SLICE = 8_000_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def split_rare(words: np.ndarray, owner: np.ndarray, least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive the splitting, in order, and the number of the piece that each lies in.

    ``words``: numbers of words; ``owner``: never-falling number of the text each word is in.
    """
    places, piece = np.arange(len(words)), owner.astype(np.int64)
    width = int(words.max(initial=0)) + 1
    while len(places):
        _, name, counts = np.unique(piece * width + words[places], return_inverse=True, return_counts=True)
        kept = counts[name] >= least
        left = places[kept]
        # A piece ends where a word went, and where the piece before ended.
        new = np.ones(len(left), dtype=bool)
        new[1:] = (np.diff(left) > 1) | (np.diff(piece[kept]) > 0)
        number = np.cumsum(new) - 1
        long = np.bincount(number, minlength=1)[number] >= shortest if len(left) else np.zeros(0, bool)
        done = kept.all() and long.all()
        places, piece = left[long], number[long]
        if done:
            break
    return places, piece


def scan_lags(words: np.ndarray, piece: np.ndarray, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs inside pieces; places are those of ``words``, and ``piece`` never falls."""
    found, n = [], len(words)
    if not n:
        return found
    end = np.searchsorted(piece, piece, side="right")  # of each place's piece
    longest = int((end - np.searchsorted(piece, piece, side="left")).max())
    # Names of single words in their piece: strings of two pieces never have the same name.
    name = np.unique(piece.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)[1]
    fits, size = np.arange(n), 1
    first = 1 << ((shortest // 2).bit_length() - 1)  # runs of a period up to this are twice as long
    while len(fits):
        if size >= first:
            found += _stretches(name, fits, size, shortest, repeats)
        if size * repeats >= longest and size >= first:
            break
        # Strings of twice the size, where they fit into their piece.
        at = np.zeros(n, dtype=np.int64)
        at[fits] = name
        more = fits[fits + 2 * size <= end[fits]]
        name = np.unique(at[more] * (int(at.max()) + 1) + at[more + size], return_inverse=True)[1]
        fits, size = more, 2 * size
    return sorted(set(found), key=lambda run: (run[0], run[2]))


def _stretches(name: np.ndarray, fits: np.ndarray, size: int, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """Runs whose period is at most ``size``, from the distance of each string of ``size`` words to the same one before it."""
    order = np.argsort(name, kind="stable")
    distance = np.zeros(len(fits), dtype=np.int64)
    same = name[order[1:]] == name[order[:-1]]
    distance[order[1:][same]] = (fits[order[1:]] - fits[order[:-1]])[same]
    distance[distance > size] = 0
    change = np.ones(len(fits), dtype=bool)
    change[1:] = (distance[1:] != distance[:-1]) | (np.diff(fits) > 1)
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(fits)) - 1
    period = distance[first]
    start, length = fits[first] - period, fits[last] + size - fits[first] + period
    good = (period > 0) & (length >= np.maximum(shortest, repeats * period))
    return list(zip(start[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield texts.slice(begin, stop - begin)
        begin = stop


def _runs_of(texts: pa.Array, shortest: int, repeats: int) -> pa.Array:
    """A slice's texts, each with its number of words, its runs and what is left."""
    # ASCII white space is \x20 and \x09-\x0D; at a text's ends it leaves empty words, which go.
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    spoken = pc.greater(pc.binary_length(lists.flatten()), 0)
    words, owner = lists.flatten().filter(spoken), owner[spoken.to_numpy(zero_copy_only=False)]
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    places, piece = split_rare(numbers, owner, repeats, shortest)
    kept = np.ones(len(words), dtype=bool)
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    for at, length, period in scan_lags(numbers[places], piece, shortest, repeats):
        start = int(places[at])
        text = int(owner[start])
        runs[text].append({"start": start - int(begin[text]), "length": length, "period": period})
        kept[start + period:start + length] = False
    offsets = np.concatenate([[0], np.cumsum(kept)])[begin]
    rest = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(kept)))
    fields = [pa.array(np.diff(begin), pa.int64()), pa.array(runs, pa.list_(_RUN)), pc.binary_join(rest, pa.scalar(" ", pa.large_string())).cast(pa.string())]
    return pa.StructArray.from_arrays(fields, fields=list(_FOUND))


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """Every row with ``n_words``, ``runs`` (by start, then period) and ``collapsed``: its words without repetitions after a run's first period."""
    if shortest < 2 or repeats < 3:
        raise ValueError("a run has two words or more, and its period three times or more")

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_runs_of(part, shortest, repeats) for part in _slices(texts)] or [pa.array([], _FOUND)])

    named = docs.drop("n_words", "runs", "collapsed").withColumn("__found", found(F.col(text)))
    return named.select("*", "__found.*").drop("__found")
