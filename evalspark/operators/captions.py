"""Caption metrics over whole texts: BLEU, ROUGE-L and CIDEr for each run, in Spark expressions; repeats within a text are counted by numpy.

A text's words are written once as 64-bit digests; the digests of its runs of one to four words are made from them wherever they are read (two different ones of a row of 100,000
words are taken for one with a probability of about 1e-9).  BLEU and whatever of CIDEr needs only the row are sums over those arrays.  Across
rows only the references' grams are counted, per run, and once for all rows with the same references.  A prediction's grams are counted in the row; those that no reference can have are
known by a table of bits and stay there, the others are joined with the references' counts, which Spark broadcasts where their size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.operators.order import join_groups
from evalspark.session import materialise

MAX_ORDER = 4
_SMALL, _TINY = 1e-9, 1e-15
_SIGMA = 6.0
_BETA = 1.2
#: Bits of one number of a row of the common-subsequence table; sums of two and a carry stay positive.
_BITS = 62
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table of grams that references have, as a power of two: 8 MB whatever the references are.
_MARKS = 26


def gram_digests(texts: Column | str) -> Column:
    """Digests of all runs of one, two, three and four words, as four arrays for each text of a row, from the digests of its words."""

    @F.arrow_udf("array<array<array<bigint>>>")
    def grown(rows: pa.Array) -> pa.Array:
        texts = rows.flatten()
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ones = texts.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ones))  # words from each one to the end of its text
        found, counts, run = [], [], ones
        for n in range(1, MAX_ORDER + 1):
            if n > 1:
                run = _scramble(run[:-1] * _STEP + ones[n - 1:]) if len(run) else run
            found.append(run[left[:len(run)] >= n])
            counts.append(np.maximum(sizes - (n - 1), 0))
        # Order by order becomes text by text.
        number = np.arange(len(sizes)) * MAX_ORDER
        order = np.argsort(np.concatenate([np.repeat(number + n, c) for n, c in enumerate(counts)]), kind="stable")
        values = np.concatenate(found)[order].view(np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(counts).T.ravel())]), pa.int32()), pa.array(values))
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * MAX_ORDER, pa.int32()), inner)
        outer = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outer)]), pa.int32()), each)

    return grown(texts)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shared(hyps: pa.Array, refs: pa.Array):
    """For each row that has references: its number, the order of each distinct gram of them, the gram, and how often the prediction and each reference have it."""
    orders, texts = hyps.flatten(), refs.flatten()
    own, theirs = orders.flatten().to_numpy(zero_copy_only=False), texts.flatten().flatten().to_numpy(zero_copy_only=False)

    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def edges(*levels: np.ndarray) -> np.ndarray:
        """Where the values of each list begin, through the lists inside it."""
        at = np.concatenate([[0], np.cumsum(levels[-1])])
        for level in reversed(levels[:-1]):
            at = at[np.concatenate([[0], np.cumsum(level)])]
        return at

    h_at = edges(sizes(hyps), sizes(orders))
    n_texts, of_text, of_order = sizes(refs), sizes(texts), sizes(texts.flatten())
    r_at, text_at = edges(n_texts, of_text, of_order), edges(of_text, of_order)
    order = np.repeat(np.concatenate([np.arange(n) for n in of_text.tolist()]) if len(of_text) else of_text, of_order)
    first_text = np.concatenate([[0], np.cumsum(n_texts)])
    for row in np.flatnonzero(n_texts).tolist():
        begin, end = r_at[row], r_at[row + 1]
        grams, first, back = np.unique(theirs[begin:end], return_index=True, return_inverse=True)
        mine = own[h_at[row]:h_at[row + 1]]
        if len(grams):
            place = np.searchsorted(grams, mine).clip(max=len(grams) - 1)
            times = np.bincount(place[grams[place] == mine], minlength=len(grams))
        else:
            times = np.zeros(0, np.int64)
        cuts = text_at[first_text[row]:first_text[row + 1] + 1] - begin
        yield row, order[begin + first], grams, times, [np.bincount(back[x:y], minlength=len(grams)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def clipped_matches(hyp: Column | str, refs: Column | str) -> Column:
    """For each order how many grams of the prediction some reference has, each counted as often as the reference with most of it."""

    @F.arrow_udf("array<bigint>")
    def clipped(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        found = np.zeros((len(hyps), MAX_ORDER), np.int64)
        for row, order, _, own, theirs in _shared(hyps, refs):
            np.add.at(found[row], order, np.minimum(own, np.max(theirs, axis=0)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(hyps) + 1) * MAX_ORDER, pa.int32()), pa.array(found.ravel()))

    return clipped(hyp, refs)


def shared_grams(hyp: Column | str, refs: Column | str) -> Column:
    """Grams that a prediction has in common with each of its references, and how often both have them."""
    fields = ["order", "text", "gram", "own", "theirs"]

    @F.arrow_udf("array<struct<order:bigint,text:bigint,gram:bigint,own:bigint,theirs:bigint>>")
    def shared(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        parts, counts = [np.zeros((5, 0), np.int64)], np.zeros(len(hyps), np.int64)
        for row, order, grams, own, theirs in _shared(hyps, refs):
            for text, times in enumerate(theirs):
                both = np.flatnonzero((own > 0) & (times > 0))
                if len(both):
                    parts.append(np.array([order[both], np.full(len(both), text), grams[both], own[both], times[both]]))
                    counts[row] += len(both)
        columns = [pa.array(c) for c in np.concatenate(parts, axis=1)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(columns, fields))

    return shared(hyp, refs)


def gram_counts(grams: Column | str) -> Column:
    """For each array of digests of a text: different ones, all, how often the most frequent stands, and the sum of the squares of these numbers."""

    @F.arrow_udf("array<struct<grams:bigint,total:bigint,most:bigint,squares:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        orders = texts.flatten()
        sizes = pc.fill_null(pc.list_value_length(orders), 0).to_numpy(zero_copy_only=False)
        values, edges = orders.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        different, most, squares = (np.zeros(len(sizes), np.int64) for _ in range(3))
        # One short sort for each array; one sort of a whole batch takes several times as long.
        for n in np.flatnonzero(sizes).tolist():
            each = np.sort(values[edges[n]:edges[n + 1]])
            last = np.flatnonzero(each[1:] != each[:-1])
            times = np.diff(last, prepend=-1, append=len(each) - 1)
            different[n], most[n], squares[n] = len(times), times.max(), times @ times
        columns = [different, sizes.astype(np.int64), most, squares]
        counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["grams", "total", "most", "squares"])
        outer = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outer)]), pa.int32()), counts)

    return counted(grams)


def gram_times(grams: Column | str, marks=None) -> Column:
    """Different grams of a text and how often each stands; with ``marks`` (of :func:`marked`) only those that may be in the table it was made of."""

    @F.arrow_udf("array<struct<order:bigint,gram:bigint,tf:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        bits = None if marks is None else marks.value
        orders = texts.flatten()
        sizes = pc.fill_null(pc.list_value_length(orders), 0).to_numpy(zero_copy_only=False)
        outer = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = orders.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(outer)), outer)
        order = np.arange(len(sizes)) - np.repeat(np.cumsum(outer) - outer, outer)
        each = np.repeat(np.arange(len(sizes)), sizes)
        if bits is not None:
            slot = values & ((1 << _MARKS) - 1)
            may = (bits[slot >> 6] >> (slot & 63)) & 1 == 1
            values, each = values[may], each[may]
        edges = np.searchsorted(each, np.arange(len(sizes) + 1)).tolist()
        parts, counts = [np.zeros((3, 0), np.int64)], np.zeros(len(outer), np.int64)
        for n in np.flatnonzero(np.diff(edges)).tolist():
            found, times = np.unique(values[edges[n]:edges[n + 1]], return_counts=True)
            parts.append(np.array([np.full(len(found), order[n]), found, times]))
            counts[row[n]] += len(found)
        columns = [pa.array(c) for c in np.concatenate(parts, axis=1)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(columns, ["order", "gram", "tf"]))

    return counted(grams)


def marked(table: DataFrame):
    """A broadcast table of bits, one set for each ``gram`` of ``table``; at most a number for each 64 of its bits reaches the driver."""
    slot = F.col("gram").bitwiseAND(F.lit((1 << _MARKS) - 1))
    found = table.select(F.shiftright(slot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    numbers = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << _MARKS - 6, np.int64)
    bits[numbers["at"].to_numpy(np.int64)] = numbers["bits"].to_numpy(np.int64)
    return table.sparkSession.sparkContext.broadcast(bits)


def caption_grams(
    df: DataFrame, keys: Sequence[str] = ("idx",), prediction: str = "prediction", references: str = "references", rouge: bool = False,
) -> DataFrame:
    """``keys, hyp, refs``: gram digests of the prediction and of each reference; ``hyp_words, ref_words``: digests of their words.

    Rows are spread by their keys first.  The words' digests are written once to the shared folder, as each metric reads them several times; grams
    are four times as much and are made from them on reading.  ``rouge``: also a column ``rouge_l`` (null without references), so that the texts are not spread again for it.
    """
    rows = df.select(*keys, T.as_text(prediction).alias("_h"), F.col(references).alias("_r")).repartition(*keys)
    digests = lambda text: F.transform(T.words(text), lambda w: F.xxhash64(w))
    columns = [F.when(F.col("_r").isNotNull(), digests(F.col("_h"))).alias("hyp_words"), F.transform("_r", digests).alias("ref_words")]
    if rouge:
        columns.append(_rouge_of("_h", "_r").alias("rouge_l"))
    words = materialise(rows.select(*keys, *columns), "words")
    return words.withColumns({"hyp": F.get(gram_digests(F.array("hyp_words")), F.lit(0)), "refs": gram_digests("ref_words")})


def _words_of(texts: Column | str) -> Column:
    """Number of words of each text, from their digests."""
    return F.transform(texts, lambda t: F.coalesce(F.size(t), F.lit(0)).cast("long"))


def bleu(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU-1..4 of each run (one row without ``by``): clipped n-gram precision, closest reference length, brevity penalty.

    Each row is counted where it is; only ten sums per run and task are shuffled.  Rows without references are left out.
    """
    sized = counted.where(F.size("ref_words") > 0).select(
        *by, F.size("hyp_words").cast("long").alias("hyp_len"), _words_of("ref_words").alias("ref_lens"), clipped_matches("hyp", "refs").alias("correct")
    )
    hyp = F.col("hyp_len")
    closest = F.array_min(F.transform("ref_lens", lambda n: F.struct(F.abs(n - hyp).alias("gap"), n.alias("len"))))["len"]
    totals = sized.groupBy(*by).agg(
        F.sum(hyp).alias("hyp"), F.sum(closest).alias("ref"),
        *[F.sum(F.get("correct", F.lit(n - 1))).alias(f"correct{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.sum(F.greatest(hyp - (n - 1), F.lit(0))).alias(f"guess{n}") for n in range(1, MAX_ORDER + 1)],
    )
    ratio = (F.col("hyp") + _TINY) / (F.col("ref") + _SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, scores = F.lit(1.0), []
    for n in range(1, MAX_ORDER + 1):
        product = product * ((F.col(f"correct{n}") + _TINY) / (F.col(f"guess{n}") + _SMALL))
        scores.append((F.pow(product, F.lit(1.0 / n)) * penalty * 100).alias(f"Bleu_{n}"))
    return totals.select(*by, *scores)


def cider(counted: DataFrame, keys: Sequence[str] = ("idx",), by: Sequence[str] = ()) -> DataFrame:
    """CIDEr of every prediction (``keys, cider``); a gram weighs by how many rows of its run have it in a reference.

    Grams that no reference has weigh the same wherever they are, so their part of a prediction's length is taken in the row.
    """
    if not by:
        return cider(counted.withColumn("_run", F.lit(0)), keys, ["_run"])
    columns = list(dict.fromkeys([*keys, *by]))
    gram = ["order", "gram"]

    def occurrences(texts: DataFrame, *kept: str) -> DataFrame:
        # The outer forms, so that no filter makes the arrays again.
        orders = texts.select(*kept, F.posexplode_outer("grams").alias("order", "each"))
        return orders.select(*kept, "order", F.explode_outer("each").alias("gram")).where("gram is not null")

    # Rows with the same references are counted first, so that their grams are listed once.  Two digests name them.
    name = F.struct(F.xxhash64("ref_words").alias("a"), F.xxhash64("ref_words", F.lit(1)).alias("b"))
    named = counted.select(*by, name.alias("set"), "ref_words")
    sets = materialise(named.groupBy(*by, "set").agg(F.first("ref_words").alias("ref_words"), F.count(F.lit(1)).alias("rows")), "references")
    texts = sets.select(*by, "set", "rows", F.posexplode_outer(gram_digests("ref_words")).alias("text", "grams"))
    in_reference = occurrences(texts, *by, "set", "rows", "text")
    frequency = in_reference.dropDuplicates([*by, "set", *gram]).groupBy(*by, *gram).agg(F.sum("rows").alias("df"))
    # One row per run.
    sizes = F.broadcast(counted.groupBy(*by).agg(F.log(F.count(F.lit(1)).cast("double")).alias("log_rows")))
    # Written, so that its size is known when the joins are planned: a small one is broadcast and no prediction's gram is shuffled.
    weights = materialise(join_groups(frequency, sizes, by).withColumn("w", F.col("log_rows") - F.log(F.col("df").cast("double"))), "weights")
    times = in_reference.groupBy(*by, "set", "text", *gram).agg(F.count(F.lit(1)).alias("tf"))
    value = F.col("tf") * F.col("w")
    per_text = join_groups(times, weights, [*by, *gram]).groupBy(*by, "set", "text", "order").agg(F.sum(value * value).alias("norm"))
    norms = per_text.groupBy(*by, "set").agg(F.collect_list(F.struct("order", "text", "norm")).alias("norms"))
    # A prediction's norm: below all its grams are added as if no reference had them.
    marks = marked(weights)

    def known(rows: DataFrame) -> DataFrame:
        mine = rows.select(*columns, F.explode_outer(gram_times("hyp", marks)).alias("g")).where("g is not null").select(*columns, "g.*")
        return join_groups(mine, weights, [*by, *gram]).select(*columns, *gram, "tf", "w", "log_rows")

    whole = F.col("tf") * F.col("log_rows")
    # Rows of one key are one text; keys that stand once need no shuffle of grams.  Written, so that the size of this mostly empty table is known.
    repeated = materialise(counted.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*columns), "repeated")
    together = known(join_groups(counted, repeated, columns, "left_semi")).groupBy(*columns, *gram).agg(
        F.sum("tf").alias("tf"), F.first("w").alias("w"), F.first("log_rows").alias("log_rows"))
    alone = known(join_groups(counted, repeated, columns, "left_anti"))
    own = alone.unionByName(together).groupBy(*columns, "order").agg(F.sum(value * value - whole * whole).alias("norm"))
    # What a prediction shares with its own references is found in the row.
    both = counted.select(*columns, F.explode(shared_grams("hyp", "refs")).alias("g")).select(*columns, "g.*")
    least = F.least(F.col("own"), F.col("theirs")) * F.col("w") * F.col("theirs") * F.col("w")
    dots = join_groups(both, weights, [*by, *gram]).groupBy(*columns, "order", "text").agg(F.sum(least).alias("dot"))
    no = F.lit(None)
    cells = own.select(*columns, "order", F.lit(-1).cast("bigint").alias("text"), "norm", no.cast("double").alias("dot")).unionByName(
        dots.select(*columns, "order", "text", no.cast("double").alias("norm"), "dot"))
    found = cells.groupBy(*columns).agg(F.collect_list(F.struct("order", "text", "norm", "dot")).alias("sums"))
    squares = F.transform(gram_counts("hyp"), lambda c: c["squares"].cast("double"))
    rows = counted.select(*columns, name.alias("set"), squares.alias("squares"), F.size("hyp_words").cast("long").alias("hyp_len"), _words_of("ref_words").alias("ref_lens"))
    with_norms = join_groups(join_groups(rows, sizes, by), norms, [*by, "set"], "left")
    return join_groups(with_norms, found, columns, "left").select(*keys, _cider_of_sums().alias("cider"))


def _cider_of_sums() -> Column:
    """Score of one prediction from its few (order, text) sums."""
    def pick(order: int, text: Column | int, name: str, sums: str = "sums") -> Column:
        return F.coalesce(F.get(F.filter(sums, lambda c: (c["order"] == order - 1) & (c["text"] == text)), F.lit(0))[name], F.lit(0.0))

    def similarity(order: int, text: Column) -> Column:
        own = F.sqrt(F.greatest(pick(order, -1, "norm") + F.get("squares", F.lit(order - 1)) * F.col("log_rows") * F.col("log_rows"), F.lit(0.0)))
        scale, dot = own * F.sqrt(pick(order, text, "norm", "norms")), pick(order, text, "dot")
        return F.when(scale != 0, dot / scale).otherwise(dot)

    def of_reference(words: Column, text: Column) -> Column:
        total = F.lit(0.0)
        for order in range(1, MAX_ORDER + 1):
            total = total + similarity(order, text)
        gap = (F.greatest(F.col("hyp_len") - 1, F.lit(0)) - F.greatest(words - 1, F.lit(0))).cast("double")
        return total * F.exp(-(gap * gap) / (2 * _SIGMA * _SIGMA))

    scores = F.transform("ref_lens", of_reference)
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("ref_lens"), F.lit(0)) / MAX_ORDER * 10.0


def common_subsequence(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two word arrays.

    A row of the table is held as bits, one for each word of ``right``, in numbers of ``_BITS`` bits; a word of ``left`` changes all of them by an
    addition whose carry goes from number to number.  The length is the number of bits that are gone at the end.
    """
    full = F.lit((1 << _BITS) - 1)
    bits = F.lit([1 << i for i in range(_BITS)])
    none = F.lit(0).cast("long")

    def masks(part: Column) -> Column:
        """Word -> the bits at which it stands: places sorted by word, and neighbours put together."""
        def entry(items: Column, at: Column, x: Column, k: Column) -> Column:
            same = F.slice(items, x + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - x)
            return F.struct(F.get(items, x)["w"].alias("key"), F.aggregate(same, none, lambda m, e: m.bitwiseOR(F.get(bits, e["i"]))).alias("value"))

        def grouped(items: Column) -> Column:
            new = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda x: (x == 0) | (F.get(items, x)["w"] != F.get(items, x - 1)["w"]))
            return T.let(new, lambda at: F.transform(at, lambda x, k: entry(items, at, x, k)))

        return F.map_from_entries(T.let(F.array_sort(F.transform(part, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), grouped))

    def changed(free: Column, hits: Column, total: Column) -> Column:
        return total.bitwiseAND(full).bitwiseOR(free.bitwiseAND(F.bitwise_not(hits)))

    def short(parts: Column) -> Column:
        """One number holds the whole row."""
        def word(free: Column, w: Column) -> Column:
            hits = free.bitwiseAND(F.coalesce(F.try_element_at(F.get(parts, F.lit(0)), w), none))
            return changed(free, hits, free + hits)

        return F.lit(_BITS) - F.bit_count(F.aggregate(left, full, word))

    def long(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(parts) - 1)

        def word(row: Column, w: Column) -> Column:
            def number(state: Column, l: Column) -> Column:  # noqa: E741
                free = F.get(row, l)
                hits = free.bitwiseAND(F.coalesce(F.try_element_at(F.get(parts, l), w), none))
                total = free + hits + state["carry"]
                return F.struct(F.array_append(state["row"], changed(free, hits, total)).alias("row"), F.shiftright(total, _BITS).alias("carry"))

            return F.aggregate(numbers, F.struct(F.array().cast("array<bigint>").alias("row"), none.alias("carry")), number, lambda s: s["row"])

        row = F.aggregate(left, F.array_repeat(full, F.size(parts)), word)
        return F.aggregate(row, F.lit(0), lambda n, x: n + _BITS - F.bit_count(x))

    def table(parts: Column) -> Column:
        return F.when(F.size(parts) == 1, short(parts)).otherwise(long(parts))

    def parts(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / _BITS).cast("int")), lambda l: masks(F.slice(words, l * _BITS + 1, _BITS)))

    return F.when((F.size(right) > 0) & (F.size(left) > 0), T.let(right, lambda words: T.let(parts(words), table))).otherwise(0)


def rouge_l(df: DataFrame, keys: Sequence[str] = ("idx",), prediction: str = "prediction", references: str = "references") -> DataFrame:
    """ROUGE-L (beta 1.2) of every prediction with its best recall and best precision over references; nothing but the texts is shuffled."""
    # Rows without references go here: a later filter would be moved below the table and make it twice.
    rows = df.where(F.size(references) > 0).select(*keys, T.as_text(prediction).alias("_h"), F.col(references).alias("_r")).repartition(*keys)
    return rows.select(*keys, _rouge_of("_h", "_r").alias("rouge_l"))


def _rouge_of(prediction: str, references: str) -> Column:
    """ROUGE-L of a row; null without references."""
    b2 = _BETA * _BETA

    def score(best: Column) -> Column:
        p, r = best["p"], best["r"]
        return F.when((p != 0) & (r != 0), (1 + b2) * p * r / (r + b2 * p)).otherwise(0.0)

    def best(h: Column) -> Column:
        shared = F.transform(references, lambda r: T.let(F.split(r, " "), lambda words: F.struct(common_subsequence(h, words).alias("lcs"), F.size(words).alias("n"))))
        return T.let(shared, lambda found: F.struct(
            F.array_max(F.transform(found, lambda x: x["lcs"] / F.size(h))).alias("p"), F.array_max(F.transform(found, lambda x: x["lcs"] / x["n"])).alias("r")))

    return F.when(F.size(references) > 0, T.let(T.let(F.split(prediction, " "), best), score))


def gram_profile(counted: DataFrame) -> DataFrame:
    """Distinct and total grams of predictions (-1) and of each reference: ``ref, order, grams, total, most``.

    A row adds up its own grams first, so one small row per text and order is grouped.
    """
    texts = counted.select(F.posexplode_outer(F.concat(F.array("hyp"), F.col("refs"))).alias("text", "grams")).where("text is not null")
    orders = texts.select((F.col("text") - 1).alias("ref"), gram_counts("grams").alias("orders"))
    rows = orders.select("ref", F.posexplode_outer("orders").alias("at", "s")).select("ref", (F.col("at") + 1).alias("order"), "s.*").where("total > 0")
    return rows.groupBy("ref", "order").agg(F.sum("grams").alias("grams"), F.sum("total").alias("total"), F.max("most").alias("most"))
