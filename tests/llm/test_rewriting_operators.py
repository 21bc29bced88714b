"""Periodic runs, chunk-table encoding and conversation repair against brute force and the library, with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from evalspark.llm import conversations, periodic_runs, piece_bpe, queries

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 periodic runs


def runs_of(words, shortest=24, repeats=3):
    """Every lag, every stretch of equal words that far apart; of equal stretches the least lag."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    n, kinds = rng.randint(0, 150), rng.choice([1, 2, 3, 9])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, e = rng.randrange(n), rng.randint(0, n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words[a:e] = [words[a + (i - a) % p] for i in range(a, e)]
    return [f"w{w}" for w in words]


@pytest.mark.parametrize("shortest, repeats", [(24, 3), (9, 3), (2, 3), (10, 5)])
def test_runs_equal_brute_force(spark, shortest, repeats):
    rng = random.Random(shortest * repeats)
    texts = [random_words(rng) for _ in range(300)]
    docs = spark.createDataFrame([(i, " \n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in periodic_runs.find_runs(docs, shortest=shortest, repeats=repeats).collect():
        expected = runs_of(texts[r.doc_id], shortest, repeats)
        assert [tuple(x) for x in r.runs] == expected
        assert r.n_words == len(texts[r.doc_id]) and r.collapsed == collapsed(texts[r.doc_id], expected)


def test_runs_of_odd_rows(spark):
    odd = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x  y\x0bz " * 8, "  " * 30, "é " * 40]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(odd)] * 2, "doc_id long, text string, runs string, other int")
    got = periodic_runs.find_runs(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "other", "n_words", "runs", "collapsed"])
    rows = got.collect()
    assert len(rows) == 2 * len(odd)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", odd[r.doc_id] or "")
        assert [tuple(x) for x in r.runs] == runs_of(words) and r.collapsed == collapsed(words, runs_of(words))
    assert periodic_runs.find_runs(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, repeats=2)


def test_runs_of_very_long_texts(spark):
    rng = random.Random(8)
    plain = [str(rng.randrange(60_000)) for _ in range(500_000)]
    two = [rng.choice("ab") for _ in range(200_000)]
    period = [f"p{i}" for i in range(3000)]
    texts = [plain[:400_000] + period * 5 + plain[400_000:], two]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(docs).drop("text").collect()}
    assert got[0] == [(400_000, 15_000, 3000)]
    # A vocabulary of two words splits nowhere; each run is checked by its definition, and short periods are counted one by one.
    for s, n, q in got[1]:
        assert all(two[i] == two[i + q] for i in range(s, s + n - q)) and n >= max(24, 3 * q)
        assert (s == 0 or two[s - 1] != two[s - 1 + q]) and (s + n == len(two) or two[s + n] != two[s + n - q])
    short = [r for r in got[1] if r[2] <= 8]
    assert short == [r for r in runs_up_to(two, 8)]


def runs_up_to(words, most):
    found = {}
    for q in range(1, most + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= 24:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def test_periodic_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])[:6000]
        if len(words) == 6000:
            continue  # the slow count; long texts have a test of their own
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))


# 12 pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


ODD = [
    "", None, " ", "  ", "a", "a  b ", "\n\n x", "x\ny \n z▁q", "\r\n\t x  ", "é中文\U0001f600 " * 50, "a" * 5000, "\x00 \x01", " " * 3000 + "x",
    "<s> </s> <0x0A>", "x \n", " ", *[f"word{i}  and\nline " * 300 for i in range(4)], "same row", "same row",
]


@pytest.mark.parametrize("size", [8_000_000, 1000, 50])
def test_chunk_table_equals_library(spark, library, size):
    model = piece_bpe.load(spark)
    docs = spark.createDataFrame([(i, t, "clash", [i]) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, other array<int>")
    got = piece_bpe.decode(piece_bpe.encode(docs.repartition(3), model, size=size), model)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "other"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        ids = library.encode(text or "")
        assert rows[i].ids == ids and rows[i].decoded == (library.decode(ids) if ids else "") and rows[i].other == [i]


def test_chunk_table_of_no_rows_and_long_texts(spark, library):
    model = piece_bpe.load(spark)
    docs = spark.createDataFrame([(1, "lorem ipsum é " * 400_000), (2, "x" * 200_000)], "doc_id long, text string")
    assert piece_bpe.encode(docs.limit(0), model).isEmpty()
    got = {r.doc_id: r.ids for r in piece_bpe.encode(docs, model, size=1_000_000).collect()}
    assert got[1] == library.encode("lorem ipsum é " * 400_000) and got[2] == library.encode("x" * 200_000)


def test_numbers_pack():
    import numpy as np

    rng = random.Random(4)
    for _ in range(50):
        numbers = np.array([rng.randrange(1 << rng.randint(1, 30)) for _ in range(rng.randint(0, 40))], dtype=np.int64)
        packed = piece_bpe._pack(numbers)
        assert piece_bpe._unpack(packed, len(numbers)).tolist() == numbers.tolist()
        assert piece_bpe._unpack_lengths(packed + b"more", len(numbers))[1] == len(packed)


def test_input_that_changes_fails(spark):
    model = piece_bpe.load(spark)
    slices = piece_bpe.placed(spark.createDataFrame([(0, "a b")], "__row long, text string"), model, "text", 100, 64)
    other = piece_bpe.answered(piece_bpe.asked(spark.createDataFrame([(0, "a c")], "__row long, text string"), model, "text", 100, 64), model)
    joined = slices.groupBy("__slice").cogroup(other.groupBy("slice")).applyInArrow(piece_bpe._join_back, "__row long, __part long, __parts long, ids array<int>")
    with pytest.raises(Exception, match="read differently"):
        joined.collect()


def test_piece_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_piece_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids) if ids else "")


# 13 conversations

PATTERN = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FIXED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """Report and lines of one conversation: exact costs from the end, then the least edit in ASCII order that keeps them."""
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
    rows = sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, digest(q[2], q[3])))
    turns = [q[1] for q in rows if q[1] is not None]
    faults, seen = [], set()
    for _, _, r, x in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not chars else "duplicate" if (r, x) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((r, x))

    def moves(i, state):
        yield "I", 5, i, FIXED[state][1], FIXED[state][0] + ":"
        if i < len(rows):
            yield "D", 2, i + 1, state, None
            if faults[i] not in ("blank", "duplicate"):
                late, (_, _, r, x) = 5 * (faults[i] == "truncated"), rows[i]
                if r[:1] in PATTERN[state]:
                    yield "K", late, i + 1, PATTERN[state][r[:1]], f"{r}:{x}"
                yield "R", 1 + late, i + 1, FIXED[state][1], f"{FIXED[state][0]}:{x}"

    n = len(rows)
    rest = {(n, s): 0 if s in (0, 3) else 10**9 for s in range(4)}
    for i in range(n, -1, -1):
        for s in range(4):
            rest.setdefault((i, s), min(c + rest[j, t] for _, c, j, t, _ in moves(i, s) if j > i) if i < n else 0)
        for _ in range(4):
            for s in range(4):
                rest[i, s] = min(rest[i, s], 5 + rest[i, FIXED[s][1]])
    i, s, audit, lines = 0, 0, "", []
    while i < n or s not in (0, 3):
        letter, _, j, t, line = min(m for m in moves(i, s) if m[1] + rest[m[2], m[3]] == rest[i, s])
        audit += letter
        lines += [line] if line is not None else []
        i, s = j, t
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), rest[0, 0], audit, sha("\n".join(lines)),
    )


def expected(table):
    by = {q[0]: [] for q in table}
    for q in damaged(table):
        by[q[0]].append(q)
    return {k: repaired(v) for k, v in by.items()}


def tables_of(rng):
    texts, rows = ["a.", "b", "  ", None, "", "c!", "Why? ", "x. y", "ü "], []
    for c in [*range(40), None, -7]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", "system", None, "", "tool", "agent"]), rng.choice(texts)))
    for c, n in ((1000, 300), (1001, 129), (1002, 128)):
        for t in range(n):
            text = rng.choice(texts) if rng.random() < 0.3 else f"line {rng.randrange(10**6)}{rng.choice(['.', '', '!'])}"
            rows.append((c, t if t % 7 else None, rng.choice(["user", "user", "assistant", "system", "bot"]), text))
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("segment, fan", [(128, 1024), (8, 4)])
def test_repair_equals_exact_costs(spark, tmp_path, monkeypatch, segment, fan):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = tables_of(random.Random(5))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert got == expected(rows)


def test_repair_of_no_rows_and_copies(spark):
    kind = "conv_id long, turn long, role string, text string, copies long, edit string"
    repaired_rows, report = conversations.repair(spark.createDataFrame([], kind))
    assert repaired_rows.isEmpty() and report.isEmpty() and conversations.digests(repaired_rows).isEmpty()
    rows = [(1, 0, "user", "hi.", 1000, "clash"), (1, 1, "assistant", "ho.", 1, None), (1, 1, "assistant", "ho.", 2, None)]
    repaired_rows, report = conversations.repair(spark.createDataFrame(rows, kind))
    r = report.first()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (1001, 1001, 2002, "K" + "D" * 999 + "KDD")
    assert [(x.role, x.text) for x in repaired_rows.orderBy("pos", "step").collect()] == [("user", "hi."), ("assistant", "ho.")]


def test_search_is_least(spark):
    """All sequences of edits with at most two inserts, one by one."""
    rng = random.Random(9)
    for _ in range(60):
        codes = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(0, 5)))
        found = []

        def walk(i, state, cost, path, inserts):
            if i == len(codes) and state in conversations.ENDS:
                found.append((cost, path))
            if inserts < 2:
                walk(i, FIXED[state][1], cost + 5, path + "I", inserts + 1)
            if i < len(codes):
                code, late = codes[i].lower(), 5 * codes[i].isupper()
                walk(i + 1, state, cost + 2, path + "D", inserts)
                if code != "-":
                    if code in PATTERN[state]:
                        walk(i + 1, PATTERN[state][code], cost + late, path + "K", inserts)
                    walk(i + 1, FIXED[state][1], cost + 1 + late, path + "R", inserts)

        walk(0, 0, 0, "", 0)
        assert conversations.search(codes, 0, None)[:2] == min(found), codes
