"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of about 800 bytes.  Each passage is described by shares of character classes, of class pairs and of
repeated words.  A small network embeds every passage and weighs it with gated attention (tanh and sigmoid branches); a bag's
representation is the weighted sum of its embeddings, and the document label is all that is learned from.  The network is fitted
on a bounded, documented sample of labelled rows (``Bounds``); scoring covers every passage of every text.

Cases: null and empty texts are one empty passage; repeated rows score alike; with no labels, or labels of one kind only, every
text scores that kind's share (0.5 without labels); an empty table gives an empty table; columns of other names pass through,
columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 800
#: Texts are described so many bytes at a time; bounds memory.
SLICE = 4 << 20


@dataclass(frozen=True)
class Bounds:
    """The labelled rows that are learned from: all, up to so many of each label, those whose hashed id is smallest."""

    positive: int = 4_000
    negative: int = 4_000
    epochs: int = 60
    seed: int = 7


def _classes() -> np.ndarray:
    """Byte to one of 24 classes; the first eight are merged kinds for pairs."""
    kinds = np.full(256, 6, np.uint8)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0xC0:
            kinds[byte] = 4
        elif byte >= 0x80:
            kinds[byte] = 5
        elif "a" <= char <= "z":
            kinds[byte] = 0
        elif "A" <= char <= "Z":
            kinds[byte] = 1
        elif "0" <= char <= "9":
            kinds[byte] = 2
        elif char in " \t\n\r\v\f":
            kinds[byte] = 3
        elif char in ".,;:!?'\"":
            kinds[byte] = 7
    return kinds


KINDS = _classes()
MARKS = np.zeros(256, np.uint8)
for _number, _char in enumerate("\n\t.,;:!?|#$%&*@-/\\()[]{}<>=+_~'\"", 1):
    MARKS[ord(_char)] = _number
N_MARKS = int(MARKS.max()) + 1
MIX = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
WIDTH = 8 + 64 + N_MARKS + 6


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32, one row each) and the number of passages of each text."""
    blobs = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(b) // PASSAGE)) for b in blobs], np.int64)
    out, first, size = [], 0, 0
    for at, blob in enumerate(blobs):
        size += len(blob)
        if size >= SLICE or at == len(blobs) - 1:
            out.append(_features(blobs[first:at + 1], counts[first:at + 1]))
            first, size = at + 1, 0
    return (np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)), counts


def _features(blobs: list[bytes], counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    starts = np.cumsum(counts) - counts
    # Sizes of the passages: all full but for the last of each text.
    length = np.full(total, PASSAGE, np.int64)
    length[starts + counts - 1] = sizes - PASSAGE * (counts - 1)
    passage = np.repeat(np.arange(total, dtype=np.int64), length)
    n = np.maximum(length, 1)[:, None].astype(np.float32)
    kind = KINDS[data]
    single = np.bincount(passage * 8 + kind, minlength=total * 8).reshape(total, 8)
    if len(data) > 1:
        same = passage[1:] == passage[:-1]
        pair = (passage[:-1] * 64 + kind[:-1] * np.int64(8) + kind[1:])[same]
        pairs = np.bincount(pair, minlength=total * 64).reshape(total, 64)
    else:
        pairs = np.zeros((total, 64), np.int64)
    marks = np.bincount(passage * N_MARKS + MARKS[data], minlength=total * N_MARKS).reshape(total, N_MARKS)
    words = _words(data, kind, passage, total)
    return np.concatenate([np.sqrt(single / n), np.sqrt(pairs / n), np.sqrt(marks / n), words, np.log1p(n) / 7], axis=1).astype(np.float32)


def _words(data: np.ndarray, kind: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Mean length, share of long words, of distinct words, of words equal to the one before and to the one before that."""
    out = np.zeros((total, 5), np.float32)
    inside = kind != 3
    if not inside.any():
        return out
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (passage[1:] != passage[:-1])]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:] | (passage[1:] != passage[:-1]), [True]])) + 1
    size = end - begin
    # A word's key mixes its bytes with their places; equal words have equal keys.
    where = np.flatnonzero(inside)
    place = (np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    mixed = MIX[data[where]] * (place * np.uint64(2) + np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    key = np.add.reduceat(mixed, np.cumsum(size) - size)
    own = passage[begin]
    n = np.bincount(own, minlength=total)
    safe = np.maximum(n, 1).astype(np.float32)
    out[:, 0] = np.log1p(np.bincount(own, weights=size, minlength=total) / safe) / 3
    out[:, 1] = np.bincount(own, weights=size > 12, minlength=total) / safe
    order = np.lexsort((key, own))
    fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])])
    out[:, 2] = np.bincount(own[order], weights=fresh, minlength=total) / safe
    for lag in (1, 2):
        equal = (key[lag:] == key[:-lag]) & (own[lag:] == own[:-lag])
        out[:, 2 + lag] = np.bincount(own[lag:], weights=equal, minlength=total) / safe
    return out


class Network:
    """Embedding, gated attention and output layer; a few thousand numbers."""

    SHAPES = (("embed", (WIDTH, 24)), ("embed_b", (24,)), ("tan", (24, 12)), ("gate", (24, 12)), ("attend", (12,)), ("out", (24,)), ("out_b", (1,)))

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), None
        self.w = {k: (draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in ("attend", "out") else np.zeros(s)) for k, s in self.SHAPES}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.w, np.cumsum(counts) - counts
        x = (x - self.mean) / self.scale
        pre = x @ w["embed"] + w["embed_b"]
        e = np.maximum(pre, 0.1 * pre)
        t, g = np.tanh(e @ w["tan"]), 1 / (1 + np.exp(-np.clip(e @ w["gate"], -30, 30)))
        s = (t * g) @ w["attend"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(e * a[:, None], first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return {"x": x, "pre": pre, "e": e, "t": t, "g": g, "a": a, "z": z, "p": p, "first": first}

    def gradients(self, f: dict, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, bag = self.w, np.repeat(np.arange(len(counts)), counts)
        d_logit = (f["p"] - y) * weight / weight.sum()
        d_z = d_logit[:, None] * w["out"]
        d_a = (f["e"] * d_z[bag]).sum(1)
        d_s = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, f["first"]), counts))
        d_t, d_g = d_s[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2), d_s[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
        d_e = f["a"][:, None] * d_z[bag] + d_t @ w["tan"].T + d_g @ w["gate"].T
        d_pre = d_e * np.where(f["pre"] > 0, 1.0, 0.1)
        return {
            "embed": f["x"].T @ d_pre, "embed_b": d_pre.sum(0), "tan": f["e"].T @ d_t, "gate": f["e"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_s, "out": f["z"].T @ d_logit, "out_b": np.array([d_logit.sum()]),
        }

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int, seed: int, batch: int = 256) -> Network:
        """Adam over shuffled bags; both labels weigh the same in the loss' gradient but for a prior that keeps the scale."""
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        first = np.cumsum(counts) - counts
        moments = {k: (np.zeros(s), np.zeros(s)) for k, s in self.SHAPES}
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(counts))
            for begin in range(0, len(order), batch):
                own = order[begin:begin + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in own])
                f = self.forward(x[rows], counts[own])
                grads, step = self.gradients(f, counts[own], y[own], np.ones(len(own))), step + 1
                rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
                for k, grad in grads.items():
                    grad = grad + 1e-4 * self.w[k]
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    self.w[k] = self.w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, passages and greatest attention weight of each text."""
        x, counts = describe(texts)
        if self.constant is not None:
            return np.full(len(texts), self.constant), counts, 1 / counts
        f = self.forward(x, counts)
        return f["p"], counts, np.maximum.reduceat(f["a"], f["first"])


def learn(documents: DataFrame, labels: DataFrame, bounds: Bounds | None = None) -> Network:
    """A network from labelled rows (``labels``: doc_id, quality; ``documents``: doc_id, text)."""
    bounds = bounds or Bounds()
    network = Network(bounds.seed)
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = own.filter("quality = 1").orderBy(order).limit(bounds.positive).unionByName(own.filter("quality = 0").orderBy(order).limit(bounds.negative))
    rows = chosen.toPandas()  # ids and labels only, at most positive + negative rows
    share = float(own.agg(F.avg("quality")).first()[0] or 0.0) if len(rows) else 0.5
    if rows.quality.nunique() < 2:
        network.constant = share
        return network

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, counts = describe(frame.text.tolist())
            first = np.cumsum(counts) - counts
            yield pd.DataFrame({
                "doc_id": frame.doc_id, "quality": frame.quality, "n": counts,
                "x": [x[a:a + n].astype(np.float16).tobytes() for a, n in zip(first, counts, strict=True)],
            })

    spark = documents.sparkSession
    sample = documents.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(rows, "doc_id long, quality int")), "doc_id")
    kept = sample.mapInPandas(passages, "doc_id long, quality int, n long, x binary").toPandas().sort_values(["doc_id", "n", "x"])
    if kept.empty:
        network.constant = share
        return network
    x = np.concatenate([np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in kept.x]).astype(np.float32)
    y = kept.quality.to_numpy(np.float64)
    network.fit(x, kept.n.to_numpy(), y, bounds.epochs, bounds.seed)
    # The sample holds more of the rare label than the rows do; the output is moved back to the shares of all labelled rows.
    drawn = y.mean()
    if 0 < share < 1:
        network.w["out_b"] = network.w["out_b"] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return network


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1), ``n_passages`` and ``top_attention`` of its whole text."""
    names = ("score", "n_passages", "top_attention")

    @F.arrow_udf("struct<score:double,n_passages:long,top_attention:double>")
    def score_texts(texts: pa.Array) -> pa.Array:
        found = network.score(texts.to_pylist()) if len(texts) else ([], [], [])
        columns = [pa.array(c, k) for c, k in zip(found, (pa.float64(), pa.int64(), pa.float64()), strict=True)]
        return pa.StructArray.from_arrays(columns, names)

    scored = docs.drop(*names).withColumn("__quality", score_texts(F.col(text)))
    return scored.select(*(c for c in scored.columns if c != "__quality"), *(F.col(f"__quality.{n}").alias(n) for n in names))
