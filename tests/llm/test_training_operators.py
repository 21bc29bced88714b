"""The training-text operators against brute force, round trips and held-out labels, with nulls, empties, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from evalspark.llm import (
    byte_bpe,
    exact_dedup,
    fingerprints,
    language_model,
    mixing,
    near_dedup,
    quality,
    queries,
    repeats,
    token_counts,
    toxicity,
)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [
    (1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, " "), (6, "x " * 100), (7, "x " * 100), (8, "q"), (9, "Q"), (11, "it's   \n\n  " * 60),
    (10, "a b c d e f g h i j k"), (12, "a b c d e f g h i j z"), (13, "b c d e f g h i j z y"), (14, "é中文" * 90 + "\U0001f600" * 20), (15, "a" * 3000), (16, "a  b ▁ "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


# 1 toxicity


def test_toxicity_matches():
    lexicon = toxicity.Lexicon()
    found = lambda text: [m[:3] for m in lexicon.matches(text)]
    assert found("you are an idiot!") == [("idiot", 0, False)]
    assert found("you idoit, st*pid and pathtic") == [("idiot", 1, False), ("stupid", 1, False), ("pathetic", 1, False)]
    assert found("diisgustin") == [("disgusting", 2, False)]
    assert found("scums scum") == [("scum", 0, False)]  # short words allow no edit
    assert found('he said "idiot" and left') == [("idiot", 0, True)]
    assert found("a calm text") == []
    assert lexicon.score("you are an idiot")[0] >= 0.7 > lexicon.score('the word "idiot" is rude')[0]
    assert lexicon.score(None) == lexicon.score("") and 0 <= lexicon.score("")[0] < 0.1


def test_automaton_is_edit_distance():
    lexicon = toxicity.Lexicon(words={"trash": 1.0, "worthless": 1.0})

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    variants = {"trash", "worthless"}
    for _ in range(2):
        variants |= {v[:i] + c + v[j:] for v in sorted(variants)[:60] for i in range(len(v) + 1) for j in (i, i + 1) for c in ("", "o")}
    variants |= {"rtash", "wrothlses", "hello", ""}
    for v in sorted(variants):
        best = min(((distance(v, t), t) for t in ("trash", "worthless") if distance(v, t) <= toxicity.edits_allowed(t)), default=None)
        found = lexicon.match(v)
        assert (found and found[::-1]) == best, v


def test_toxicity_held_out(spark, docs):
    folder = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op1_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_toxicity_without_labels(spark, docs, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score(odd.withColumn("score", F.lit("clash")).withColumn("other", F.lit(1)), lexicon)
    assert got.count() == len(ODD) and "other" in got.columns and got.filter("score < 0 or score > 1 or score is null").isEmpty()
    assert toxicity.score(empty, lexicon).isEmpty()


# 2 quality


def test_quality_gradients():
    import numpy as np

    draw = np.random.default_rng(1)
    network, counts = quality.Network(3), np.array([1, 3, 2])
    x, y = draw.normal(size=(6, quality.WIDTH)), np.array([1.0, 0.0, 1.0])

    def loss():
        p = network.forward(x, counts)["p"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = network.gradients(network.forward(x, counts), counts, y, np.ones(3))
    for name, grad in grads.items():
        at = tuple(0 for _ in grad.shape)
        kept = network.w[name][at]
        network.w[name][at] = kept + 1e-5
        up = loss()
        network.w[name][at] = kept - 1e-5
        down = loss()
        network.w[name][at] = kept
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-5, name
    f = network.forward(x, counts)
    assert np.allclose(np.add.reduceat(f["a"], f["first"]), 1)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op2_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_quality_edges(spark, docs, odd, empty):
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    network = quality.Network()
    got = quality.score(odd.withColumn("score", F.lit("clash")), network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, network).isEmpty()
    one = quality.describe(["x" * 5000, None])
    assert list(one[1]) == [7, 1] and one[0].shape == (8, quality.WIDTH)


# 3 mixing


def test_mixing(spark, docs):
    got = [r.asDict() for r in queries.QUERIES["op3_mixing"](spark, FOLDER).collect()]
    again = [r.asDict() for r in queries.QUERIES["op3_mixing"](spark, FOLDER).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key)
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        targets[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    # Share again by weight until no source is above its cap.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            want |= share
            break
        for s in above:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= above
    for s in sizes:
        assert math.isclose(targets[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 1


def test_mixing_permutes(spark):
    n = spark.range(1, 120).select(F.col("id").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    p = n.select("n", mixing._spin(F.col("i"), F.col("n"), F.lit(3), 1).alias("p")).groupBy("n")
    assert p.agg(F.countDistinct("p").alias("c"), F.min("p").alias("a"), F.max("p").alias("b")).filter("c <> n or a <> 0 or b <> n - 1").isEmpty()


def test_mixing_edges(spark, empty):
    rows = [(1, "a b c", "s"), (2, None, "s"), (2, " ", None), (3, "d", None), (3, "d", None), (None, "e f", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 7 and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.taken_words(empty.withColumn("source", F.lit("s"))).isEmpty()
    for r in mixing.mix_documents(docs).collect():
        assert r.text.split("\n")[0] in ("a b c", "d", "e f") and set(r.text.split()) <= set(dict(zip((1, 3, None), ("a b c", "d", "e f"), strict=True))[r.doc_id].split())
    none = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.taken_words(none).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mixing_texts(docs):
    mixed = mixing.mix_documents(docs).select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n"))
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken}
    counted = {r.doc_id: r.n for r in mixed.collect()}
    assert counted.keys() == taken.keys()  # the same rows in the same order get the same numbers
    assert sum(counted.values()) == sum(taken.values())


# 4 token counts


def test_token_counts(spark, docs, odd, empty):
    model = token_counts.load(spark)
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert model.value.own and model.value.by_word
    for table in (docs.select("doc_id", "text"), odd):
        for r in token_counts.count_tokens(table, model).collect():
            assert (r.n_tokens, r.n_bytes) == (len(own.encode(r.text or "")), len((r.text or "").encode()))
    assert token_counts.count_tokens(empty, model).isEmpty()


def test_token_cache(spark, odd, tmp_path):
    model, cache = token_counts.load(spark), f"file://{tmp_path}/cache"
    first = token_counts.count_tokens(odd, model, cache=cache).count()
    stored = spark.read.parquet(cache)
    assert first == len(ODD) and stored.count() == len({t or "" for _, t in ODD})
    more = spark.createDataFrame([(1, "a b"), (2, "quite new"), (3, "quite new")], SCHEMA)
    assert token_counts.count_tokens(more.withColumn("n_tokens", F.lit("clash")), model, cache=cache).count() == 3
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ODD}) + 1  # one new content, counted once
    # Stored counts are taken, not made again; those of another version are not.
    spark.createDataFrame([(hashlib.sha256(b"planted").digest(), model.value.version, 77), (hashlib.sha256(b"other").digest(), "v0", 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = {r.text: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame([(1, "planted"), (2, "other")], SCHEMA), model, cache=cache).collect()}
    assert got["planted"] == 77 and got["other"] != 77


# 5 repeated strings


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for key, text in rows:
        blob = (text or "").encode()
        covered = bytearray(len(blob))
        for k in range(len(blob) - length + 1):
            string = blob[k:k + length]
            if string in seen:
                covered[k:k + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, c in zip(blob, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((key, len(blob), sum(covered), spans, kept))
    return out


@pytest.mark.parametrize("together", [20_000, 1])
def test_repeats(docs, rows, together):
    got = repeats.remove_repeats(docs, together=together).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute_repeats(rows)


def test_repeats_edges(spark, empty):
    rows = [(1, "ab " * 200), (2, "ab " * 40), (3, None), (4, ""), (5, "x" * 99), (6, "x" * 100), (7, "x" * 101), (8, "é" * 300), (9, "q" * 50 + "é" * 60),
            (10, "the quick brown fox " * 3 + "z" * 30), (11, "zz" + "the quick brown fox " * 3 + "z" * 60)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows)
    twice = spark.createDataFrame([(1, "x" * 150), (1, "x" * 150), (None, "x" * 120), (2, "a")], SCHEMA)
    found = [(r.doc_id, r.n_removed) for r in repeats.remove_repeats(twice).collect()]
    assert sorted(found, key=str) == [(1, 149), (1, 150), (2, 0), (None, 120)]
    assert repeats.remove_repeats(empty).isEmpty()


# 6 fingerprints


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.edit_report(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (key, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        assert got[key].n_chars == len(text) and got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[key].near_edited <= 1 and 0 <= got[key].near_next <= 1
        assert prints.setdefault(text, got[key].fingerprint) == got[key].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())


def test_fingerprint_algebra(spark):
    texts = [("a", "One two. Three four.\nFive, six."), ("b", "Seven eight!\nNine."), ("ab", "Seven eight!\nNine.\nFive, six.\nOne two. Three four."), ("none", "")]
    made = fingerprints.vectors(spark.createDataFrame(texts, "k string, text string"), ["k"], "text")
    v = made.groupBy().pivot("k", ["a", "b", "ab", "none"]).agg(F.first("vector"))
    same = lambda x, y: fingerprints.as_text(x) == fingerprints.as_text(y)
    a, b, ab, none = (F.col(c) for c in ("a", "b", "ab", "none"))
    checks = v.select(same(fingerprints.combine(a, b), ab), same(fingerprints.combine(ab, a, -1), b), same(fingerprints.combine(a, a, -1), none), fingerprints.likeness(a, a) == 1, fingerprints.likeness(a, b) == 0)
    assert all(checks.first())


def test_fingerprint_edges(spark, empty):
    rows = [(1, "a b"), (2, None), (3, ""), (3, "x. y"), (3, "x. y"), (None, "q")]
    got = fingerprints.edit_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r.near_edited for r in got if r.n_chars == 0} == {1.0}
    assert fingerprints.edit_report(empty).isEmpty()
    alone = fingerprints.edit_report(spark.createDataFrame([(1, "one two")], SCHEMA)).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("n", [40, 50_000, 1_000_000])
def test_fingerprint_likeness_of_long_texts(spark, n):
    """Shares of common clauses, for short texts and for a million clauses."""
    made = lambda kept: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.when(i <= kept, "c").otherwise("d"), i.cast("string"))), "\n")
    texts = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), made(kept).alias("text")) for k, kept in (("all", n), ("most", n * 19 // 20), ("half", n // 2))))).alias("t")).select("t.*")
    v = fingerprints.vectors(texts, ["k"], "text").groupBy().pivot("k", ["all", "most", "half"]).agg(F.first("vector"))
    most, half = v.select(fingerprints.likeness(F.col("all"), F.col("most")), fingerprints.likeness(F.col("all"), F.col("half"))).first()
    assert abs(most - 19 / 21) < 0.1 and abs(half - 1 / 3) < 0.1


# 7 exact copies


@pytest.mark.parametrize("options", [{}, {"block": 10}, {"block": 10, "digest": lambda c: F.length(c).cast("long")}])
def test_exact(spark, options):
    rows = [*ODD, (17, "x " * 99 + "y "), (8, "q"), (None, "a b")]
    got = exact_dedup.group_copies(spark.createDataFrame(rows, SCHEMA), **options).collect()
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): keys for t, keys in groups.items()}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        keys = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(k for k in keys if k is not None), len(keys))
        assert not r.kept or r.doc_id == r.keep_id


def test_exact_rows_stay_whole(spark, empty):
    rows = [(1, "a b", "x"), (2, "a  b", "y"), (3, "c", None), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == [(1, "a b", "x"), (3, "c", None)]
    assert exact_dedup.group_copies(empty).isEmpty()


# 8 near copies


def brute_near(rows, width):
    sets = []
    for _, text in rows:
        own = words(text)
        sets.append({tuple(own[k:k + width]) for k in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)} if own else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize("width", [2, 5])
def test_near(docs, rows, width):
    got = near_dedup.group_near(docs, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups(spark):
    """A group of near copies, one of texts that share half their words, and one in which some pairs are just too far apart."""
    rng = random.Random(21)
    base, plate = [f"w{i}" for i in range(80)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        rows.append((1000 + i, " ".join(plate + [f"y{rng.randrange(10**6)}" for _ in range(25)])))
        cut = rng.randrange(14)
        rows.append((2000 + i, " ".join([f"z{k}" for k in range(cut, 60 + cut)])))
    got = near_dedup.group_near(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2)


def test_near_chain_and_edges(spark, odd, empty):
    base = [f"w{i}" for i in range(60)]
    # A chain: neighbours are alike, ends are not; and a group whose band mates are unlike.
    chain = [(100 + k, " ".join(f"v{i}" if i < 5 * k else w for i, w in enumerate(base))) for k in range(9)]
    rows = ODD + chain
    got = near_dedup.group_near(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2)
    twice = spark.createDataFrame([(1, "a b"), (1, "zz yy"), (None, "a b"), (None, None), (6, "x x")], SCHEMA)
    found = near_dedup.group_near(twice, width=2).collect()
    assert len(found) == 5 and {r.component_id for r in found if r.n_shingles} == {1, 6}
    assert near_dedup.group_near(empty).isEmpty() and near_dedup.drop_near(odd, width=2).columns == odd.columns


def test_near_estimate():
    import numpy as np

    draw = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        n = 20_000
        common = draw.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2)
        own = [np.unique(np.concatenate([common, draw.integers(0, 1 << 63, (n - len(common)) // 2, dtype=np.uint64) * np.uint64(2)])) for _ in range(2)]
        regs = [near_dedup.registers(s)[None, :] for s in own]
        assert abs(near_dedup.estimate(*regs)[0] - share) < 0.15


def test_near_estimate_keeps_pairs_at_the_threshold():
    """Of pairs of large sets with similarity just over 0.8, the estimate may lose no more than the bands."""
    least = 0.8 - near_dedup.MARGIN
    for share in (0.8, 0.805, 0.81):
        missed = sum(math.comb(128, k) * share**k * (1 - share) ** (128 - k) for k in range(math.ceil(128 * least - 1e-9)))
        assert missed < (1 - 0.8**4) ** 32


def test_near_lists_no_pairs_of_texts_that_are_not_linked(spark, monkeypatch):
    """200 copies of one text, most of them linked by way of others, and 200 texts that share two thirds of their shingles: the pairs confirmed grow with the texts."""
    rng = random.Random(5)
    base, plate = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(130)]
    rows = []
    for i in range(200):
        copy = list(base)
        for _ in range(rng.randint(0, 10)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        rows.append((1000 + i, " ".join(plate + [f"y{rng.randrange(10**6)}" for _ in range(30)])))
    confirm, counts = near_dedup.confirm, []

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    got = near_dedup.group_near(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2)
    assert sum(counts) < 10 * len(rows)


def test_near_sketches_keep_links():
    """Sketches of linked sets differ in no more bits than the sets, and of large sets beyond what is allowed with less chance than the bands miss."""
    import numpy as np

    draw = np.random.default_rng(3)
    for n, most in ((50, 5), (400, 44)):
        own = np.unique(draw.integers(0, 1 << 63, n + most, dtype=np.uint64) * np.uint64(2))
        left, right = own[:n], own[most:]
        bits = np.bitwise_count(near_dedup.sketch(left) ^ near_dedup.sketch(right)).sum()
        assert 0 < bits <= 2 * most and 100 * (n - most) >= 80 * (n + most) and bits <= near_dedup.most_bits(np.array([2 * n]), 80)[0]
    # Exact chances of the number of odd cells after each throw.
    cells = near_dedup.CELLS
    odd = np.arange(cells + 1)
    chance = np.zeros(cells + 1)
    chance[0] = 1
    wanted = {int(2 * n * 20 / 180): n for n in (500, 1000, 2000, 4000, near_dedup.SKETCHED)}
    for throws in range(1, max(wanted) + 1):
        chance = np.append(0, (chance * (cells - odd) / cells)[:-1]) + np.append((chance * odd / cells)[1:], 0)
        if throws in wanted:
            allowed = near_dedup.most_bits(np.array([2 * wanted[throws]]), 80)[0]
            assert chance[odd > allowed].sum() < (1 - 0.8**4) ** 32


# 9 byte-level BPE


def test_byte_bpe(spark, docs, odd, empty):
    vocabulary = byte_bpe.load(spark)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table, options in ((docs.select("doc_id", "text"), {"chunk": 400, "overlap": 40}), (odd, {"chunk": 100, "overlap": 20}), (odd, {})):
        got = byte_bpe.decode(byte_bpe.encode(table, vocabulary, **options), vocabulary).collect()
        assert len(got) == table.count()
        for r in got:
            assert list(r.ids) == whole.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(empty, vocabulary).isEmpty()
    twice = odd.unionByName(odd).withColumn("ids", F.lit("clash"))
    assert byte_bpe.encode(twice, vocabulary, chunk=50, overlap=10).count() == 2 * len(ODD)


# 10 language model


def test_language_model(spark, rows):
    got = queries.QUERIES["op10_language_model"](spark, FOLDER).collect()
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    counts = Counter()
    for key, text in rows:
        if not held(key):
            counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    text = dict(rows)
    for r in got:
        own = [*words(text[r.doc_id]), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[w] > 0 for w in own), total, held(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_language_model_sums_to_one(spark):
    """Probabilities of all known words and the unknown one in a context."""
    texts = ["a b. c a b", "b a c", "a. b c d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    counts, history, _ = language_model.train(docs.select(F.col("text").alias("body")))
    totals = history[-1]
    for context in (0, 5 * 64 + 7, 28 * 64):
        total = 0.0
        for row in counts.toPandas().itertuples():
            own = language_model.Seating(row, row.bucket)
            p = list(own.sample(history, 1))[0]
            for w in range(len(own.vocabulary)):
                at1, at2 = (own.word1 == w) & (own.context1 == context // 64), (own.word == w) & (own.contexts == context)
                one = p[1][at1][0] if at1.any() else totals.weight(1)[context // 64] * p[0][w]
                total += p[2][at2][0] if at2.any() else totals.weight(2)[context] * one
        unknown = totals.base * totals.weight(0)[0] * totals.weight(1)[context // 64] * totals.weight(2)[context]
        assert abs(total + unknown - 1) < 0.15  # tables moved since the totals were summed


def test_language_model_totals_travel_packed(spark):
    docs = spark.createDataFrame([(f"a b c w{i} w{i % 7}",) for i in range(300)], "body string")
    counts, history, buckets = language_model.train(docs, 1)
    sums = [language_model._sums_of(language_model.Seating(row, row.bucket)) for row in counts.toPandas().itertuples()]
    # One row per bucket, whatever the number of restaurants.
    assert len(sums) <= buckets
    total = sum(sums)
    assert (history[0].tokens, history[0].words) == tuple(total[:2])
    assert history[0].customers[0][0] == total[2] and history[0].tables[0][0] == total[3]
    assert history[0].customers[2].sum() == history[0].tokens == 300 * 6


def test_language_model_edges(spark, empty):
    rows = [(1, "a b"), (2, None), (2, ""), (None, "c d e f"), (3, "a b a b"), (3, "a b a b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_model.score(docs, F.lit(True)).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    none = language_model.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.score) for r in none} == {(0, 0.0)}
    assert language_model.score(empty, F.lit(True)).isEmpty()


def test_language_model_contexts_are_words(spark):
    """Every different word before is a context of its own, however words end, and tells what follows it."""
    import numpy as np

    _, contexts, _ = language_model.tokens([" ".join(f"x{i}e" for i in range(20_000))])
    assert len(np.unique(contexts)) == 20_001
    n = 1200
    asked = [f"x{i}e y{(i + d) % n}" for i in (7, 401) for d in (0, 1)]
    docs = [(i, f"x{i}e y{i} " * 3) for i in range(n)] + [(n + i, t) for i, t in enumerate(asked)]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(docs, SCHEMA), F.col("doc_id") < n).collect()}
    assert len(got) == len(docs)
    assert got[n] > got[n + 1] + 1.5 and got[n + 2] > got[n + 3] + 1.5


def test_language_model_probabilities_add_up(spark):
    """Before tables move, all known words and the unknown one have probability one after any word; totals are those of all buckets."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 30) % 200) for _ in range(60)]
    docs = spark.createDataFrame([(t, i % 7 != 2) for i, t in enumerate(texts)], "body string, learn boolean")
    counts, history, _ = language_model.train(docs, 1)
    totals = history[0]
    buckets = [language_model.Seating(row, row.bucket) for row in counts.toPandas().itertuples()]
    pairs = Counter()
    for i, t in enumerate(texts):
        if i % 7 != 2:
            _, contexts, _ = language_model.tokens([t])
            pairs.update(contexts.tolist())
    for key in list(pairs)[:20]:
        (customers,) = {own.customers[np.flatnonzero(own.keys == key)[0]] for own in buckets if key in own.keys}
        assert customers == pairs[key]
        weight = next(own.weights(totals)[np.flatnonzero(own.keys == key)[0]] for own in buckets if key in own.keys)
        kind = key >> 48
        total = totals.base * totals.weight(0)[0] * totals.weight(1)[kind] * weight
        for own in buckets:
            p0, p1, p2 = own.probabilities(totals)
            for w in range(len(own.vocabulary)):
                at1, at2 = (own.word1 == w) & (own.context1 == kind), (own.word == w) & (own.contexts == key)
                total += p2[at2][0] if at2.any() else weight * (p1[at1][0] if at1.any() else totals.weight(1)[kind] * p0[w])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_stirling_and_tables():
    import numpy as np

    table = language_model._log_stirling(0.0)
    assert np.allclose(np.exp(table[4, 1:5]), [6, 11, 6, 1])
    draw = np.random.default_rng(1)
    n = np.array([1, 2, 60, 64, 5000])
    t = language_model._tables(n, np.full(5, 0.01), np.zeros(5), 0.5, language_model._log_stirling(0.5), draw)
    assert t[0] == 1 and np.all((t >= 1) & (t <= n))
