"""Toxicity by terms: Levenshtein automata run against a trie of the lexicon, and windows of context around each match.

``learn`` takes a bounded sample of labelled rows (``Bounds``) and finds terms that stand far more often in toxic texts: whole
words, and stems that take any ending.  Evidence is counted in different contexts (the word before), so copies of a text count
once.  ``Lexicon`` holds the words in a trie.  A word of a text is read letter by letter through the product of the trie and the
automaton that allows edits (substitution, insertion, deletion, swap); its states are built when first needed and kept, so most
words end in the dead state after two or three letters.  Words under 5 letters allow no edit, under 8 letters one, others two.
Stems are matched as they are.

A match stands for abuse or for quotation: a window of words around it is searched for quotation marks, words of reporting and
words of address.  A term's strength is the log ratio of its rates in toxic and clean texts.  A text's score is a logistic function
of its summed strengths, apart for plain, edited and quoted matches; its weights start at priors (an edited match counts half, a
quoted one nearly nothing), which hold where the sample has no example.

Cases: null and empty texts score as texts without matches; repeated rows score alike; without labels the built-in terms and priors
are used; an empty table gives an empty table; columns of other names pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import materialise

#: Plain insults that are known before any label is seen.
TERMS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "disgusting", "worthless", "pathetic", "clown")
EDGES = string.punctuation + "“”„‟«»‹›‘’‚…–—¡¿"
QUOTES = "\"'“”„‟«»‹›‘’‚`"
REPORTING = frozenset("said says say called calls wrote writes quoted quote quotes term terms word words phrase slur insult insults reported zitat sagte wort dit mot dijo palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein deine tu te toi vous tú usted eres".split())
WORDS_KEPT = 300_000


#: Weights without any label: one plain match of a known term is enough, one quoted match is not.
PRIOR = (1.0, 1.0, 0.15, -3.9)
#: Share of a term's strength that an edited form keeps as long as no clean text of the sample has one.
EDITED = 0.85


@dataclass(frozen=True)
class Bounds:
    """The labelled rows that are learned from: all, up to so many of each label, those whose hashed id is smallest."""

    positive: int = 2_500
    negative: int = 5_000
    #: A term needs this many nats against standing in toxic texts by chance, this ratio of rates, and this many texts.
    evidence: float = 14.0
    ratio: float = 5.0
    texts: int = 4
    shortest: int = 3


def edits_allowed(word: str) -> int:
    return 2 if len(word) >= 8 else 1 if len(word) >= 5 else 0


@dataclass
class Lexicon:
    """Words (matched with edits) and stems (matched as they are, any ending), each with the strength of a match."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TERMS, 6.0))
    stems: dict[str, float] = field(default_factory=dict)
    #: Strength of a match with edits, by term; other terms have EDITED of their own strength.
    edited: dict[str, float] = field(default_factory=dict)
    #: Weight of the summed strengths of plain, edited and quoted matches, and the constant.
    weights: tuple[float, float, float, float] = PRIOR
    window: int = 6

    def __post_init__(self):
        self._forget()

    def _forget(self):
        self._nodes, self._steps, self._states, self._known, self._clean = None, {}, [], {}, set()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "stems", "edited", "weights", "window")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _trie(self):
        if self._nodes is None:
            # A node: its children, the word that ends there, and the edits its longest word allows.
            nodes = [({}, None, 0)]
            for word in sorted(self.words):
                at = 0
                for letter in word:
                    children = nodes[at][0]
                    if letter not in children:
                        children[letter] = len(nodes)
                        nodes.append(({}, None, 0))
                    at = children[letter]
                nodes[at] = (nodes[at][0], word, 0)
            for at in range(len(nodes) - 1, -1, -1):
                children, word, _ = nodes[at]
                nodes[at] = (children, word, max([edits_allowed(word or ""), *(nodes[c][2] for c in children.values())]))
            self._nodes = nodes
            self._states, self._numbers = [], {}
            self._start = self._number(self._closed({(0, 0, "")}))
        return self._nodes

    def _closed(self, items):
        """With what is reached by leaving out letters of the trie."""
        todo, found = list(items), set(items)
        while todo:
            node, edits, pending = todo.pop()
            if not pending and edits < self._nodes[node][2]:
                for child in self._nodes[node][0].values():
                    if edits < self._nodes[child][2] and (item := (child, edits + 1, "")) not in found:
                        found.add(item)
                        todo.append(item)
        return frozenset(found)

    def _number(self, state):
        if state not in self._numbers:
            self._numbers[state] = len(self._states)
            ends = [(edits, self._nodes[node][1]) for node, edits, pending in state if not pending and self._nodes[node][1] and edits <= edits_allowed(self._nodes[node][1])]
            self._states.append((state, min(ends, default=None)))
        return self._numbers[state]

    def _step(self, number, letter):
        nodes, after = self._nodes, set()
        for node, edits, pending in self._states[number][0]:
            if pending:
                if letter == pending:
                    after.add((node, edits, ""))
                continue
            children = nodes[node][0]
            if letter in children:
                after.add((children[letter], edits, ""))
            if edits < nodes[node][2]:
                after.add((node, edits + 1, ""))
                for other, child in children.items():
                    if other != letter and edits < nodes[child][2]:
                        after.add((child, edits + 1, ""))
                        if letter in nodes[child][0]:
                            after.add((nodes[child][0][letter], edits + 1, other))
        return self._number(self._closed(after)) if after else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a bare word stands for and the edits between them; the fewest edits, then the first term."""
        self._trie()
        for size in {len(s) for s in self.stems}:
            if word[:size] in self.stems:
                return word[:size] + "*", 0
        at = self._start
        for letter in word:
            key = (at, letter)
            at = self._steps.get(key)
            if at is None:
                at = self._steps[key] = self._step(*key)
            if at < 0:
                return None
        found = self._states[at][1]
        return (found[1], found[0]) if found else None

    def _quoted(self, words, at):
        """Whether the window around a match reads as quotation or report rather than as abuse."""
        left, right = words[max(0, at - self.window):at], words[at + 1:at + 1 + self.window]
        own = words[at]
        near = {w.strip(EDGES) for w in words[max(0, at - 3):at + 4]}
        opened = own[0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in left)
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in right)
        if opened and closed and own.strip(EDGES):
            return True
        return bool(REPORTING & {w.strip(EDGES) for w in left[-4:]}) and not ADDRESS & near

    def matches(self, text: str) -> list[tuple[str, int, bool, str]]:
        """Term, edits, whether it is quoted, and the word, for each match in a text."""
        words = text.lower().split()
        if len(self._clean) > WORDS_KEPT:
            self._clean.clear()
        hits = []
        for word in set(words) - self._clean:
            if word not in self._known:
                found = self.match(word.strip(EDGES))
                if found is None:
                    self._clean.add(word)
                    continue
                self._known[word] = found
            hits.append(word)
        if len(self._known) > WORDS_KEPT:
            self._known = {word: self._known[word] for word in hits}
        if not hits:
            return []
        wanted = set(hits)
        return [(*self._known[word], self._quoted(words, at), word) for at, word in enumerate(words) if word in wanted]

    def features(self, text: str | None) -> tuple[list[float], tuple[int, int, int]]:
        """Summed strengths of plain, edited and quoted matches (each different word once), and how many matches of each there are."""
        words: dict[tuple[str, int, str], bool] = {}
        counts = [0, 0, 0]
        for term, edits, quoted, word in self.matches(text or ""):
            counts[2 if quoted else 1 if edits else 0] += 1
            words[term, edits, word] = words.get((term, edits, word), True) and quoted
        sums = [0.0, 0.0, 0.0]
        for (term, edits, _), quoted in words.items():
            strength = self.stems[term[:-1]] if term.endswith("*") else self.words[term]
            if edits:
                strength = self.edited.get(term, EDITED * strength)
            sums[2 if quoted else 1 if edits else 0] += strength
        return sums, tuple(counts)

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """Score, matches, edited matches, quoted matches."""
        sums, counts = self.features(text)
        logit = self.weights[3] + sum(w * s for w, s in zip(self.weights, sums, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), sum(counts), counts[1], counts[2]


def _candidates(sample: DataFrame, bounds: Bounds) -> pd.DataFrame:
    """Beginnings of words with the contexts they have in toxic and clean texts of the sample, and in how many toxic texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))
    listed = sample.select("doc_id", "toxic", words.alias("words")).filter(F.size("words") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("words", F.lit(1), F.size("words") - 1))
    pairs = listed.select("doc_id", "toxic", F.explode(F.array_distinct(F.arrays_zip(F.col("words"), before.alias("before")))).alias("pair"))
    contexts = pairs.filter(F.length("pair.words") >= bounds.shortest).groupBy("pair", "toxic").agg(F.min("doc_id").alias("doc_id"))
    sizes = F.sequence(F.lit(bounds.shortest), F.least(F.length("pair.words"), F.lit(12)))
    starts = contexts.select("toxic", "doc_id", "pair.words", F.explode(sizes).alias("size")).select(
        "toxic", "doc_id", F.substring(F.col("words"), F.lit(1), F.col("size")).alias("start"), (F.col("size") == F.length("words")).cast("int").alias("whole")
    )
    by_text = starts.groupBy("start", "toxic", "doc_id").agg(F.count("*").alias("n"), F.sum("whole").alias("whole"))
    toxic = F.col("toxic") == 1
    summed = by_text.groupBy("start").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("clean"),
        F.sum(F.when(toxic, F.col("whole")).otherwise(0)).alias("as_word"), F.sum(toxic.cast("int")).alias("texts"),
    )
    # At most one row per beginning of a toxic word of the bounded sample.
    return summed.filter((F.col("texts") >= bounds.texts) & (F.col("toxic") > F.col("clean"))).toPandas()


def _terms(found: pd.DataFrame, toxic_texts: int, clean_texts: int, bounds: Bounds) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their strengths: each beginning is followed for as long as it keeps its contexts."""
    base = min(max(toxic_texts / max(toxic_texts + clean_texts, 1), 0.01), 0.9)

    def strength(toxic: float, clean: float) -> float:
        return math.log((toxic + 0.5) / (toxic_texts + 1)) - math.log((clean + 0.5) / (clean_texts + 1))

    counts = {}
    for r in found.itertuples():
        surprise = r.toxic * math.log(1 / base) + r.clean * math.log(1 / (1 - base)) - (r.toxic + r.clean) * _entropy(r.toxic / (r.toxic + r.clean))
        if surprise >= bounds.evidence and strength(r.toxic, r.clean) >= math.log(bounds.ratio):
            counts[r.start] = (int(r.toxic), int(r.clean), int(r.as_word), strength(r.toxic, r.clean))
    children: dict[str, list[str]] = {}
    for start in counts:
        children.setdefault(start[:-1], []).append(start)
    words, stems = {}, {}
    todo = [s for s in counts if s[:-1] not in counts]
    while todo:
        start = todo.pop()
        toxic, _, as_word, own = counts[start]
        longer = children.get(start, [])
        covered = sum(counts[x][0] for x in longer)
        better = sum(counts[x][0] * counts[x][3] for x in longer) / max(covered, 1)
        if as_word >= 0.8 * toxic:
            words[start] = own
        elif covered >= 0.85 * toxic and (len(longer) == 1 or own < 0.6 * better):
            todo.extend(longer)
        else:
            stems[start] = own
    return words, stems


def _entropy(share: float) -> float:
    return -sum(x * math.log(x) for x in (share, 1 - share) if x > 0)


def _fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, ...]:
    """Logistic weights by Newton steps, drawn towards the priors; the constant is moved to the share of toxic rows overall."""
    design, prior = np.column_stack([x, np.ones(len(x))]), np.array(PRIOR)
    weights, pull = prior.copy(), np.array([4.0, 40.0, 40.0, 0.5])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(pull)
        move = np.linalg.solve(hessian, design.T @ (y - p) - pull * (weights - prior))
        weights = weights + np.clip(move, -1, 1)
    drawn = y.mean()
    if 0 < share < 1 and 0 < drawn < 1:
        weights[3] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    weights[:3] = np.maximum(weights[:3], 0.0)
    return tuple(float(w) for w in weights)


def learn(documents: DataFrame, labels: DataFrame, bounds: Bounds | None = None, terms: tuple[str, ...] = TERMS) -> Lexicon:
    """A lexicon from labelled rows (``labels``: doc_id, toxic; ``documents``: doc_id, text)."""
    bounds, lexicon = bounds or Bounds(), Lexicon(words=dict.fromkeys(terms, 6.0))
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = own.filter("toxic = 1").orderBy(order).limit(bounds.positive).unionByName(own.filter("toxic = 0").orderBy(order).limit(bounds.negative))
    rows = chosen.toPandas()  # ids and labels only, at most positive + negative rows
    if rows.empty:
        return lexicon
    spark = documents.sparkSession
    picked = documents.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int")), "doc_id")
    sample = materialise(picked, "toxicity-sample")
    toxic_texts = int(rows.toxic.sum())
    words, stems = _terms(_candidates(sample, bounds), toxic_texts, len(rows) - toxic_texts, bounds)
    lexicon.words |= words
    lexicon.stems = {s: w for s, w in stems.items() if s not in lexicon.words}

    def edited_terms(frames):
        for frame in frames:
            found = [(term, toxic) for toxic, text in zip(frame.toxic, frame.text, strict=True) for term in {t for t, e, q, _ in lexicon.matches(text or "") if e and not q}]
            yield pd.DataFrame(found, columns=["term", "toxic"])

    # Edited forms that clean texts have by accident tell little; one row per term.
    forms = sample.select("toxic", "text").mapInPandas(edited_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    for r in forms.toPandas().itertuples():
        seen = math.log((r.toxic + 3) / (r.clean + 0.01)) + math.log((len(rows) - toxic_texts + 1) / (toxic_texts + 1))
        lexicon.edited[r.term] = max(0.0, min(EDITED * lexicon.words[r.term], seen))

    def summed(frames):
        for frame in frames:
            found = [lexicon.features(text)[0] for text in frame.text]
            yield pd.DataFrame(found, columns=["plain", "edited", "quoted"]).assign(toxic=frame.toxic.to_numpy())

    share = own.agg(F.avg("toxic")).first()[0]
    x = sample.select("toxic", "text").mapInPandas(summed, "plain double, edited double, quoted double, toxic int").toPandas()
    if len(x):
        x = x.sort_values(list(x.columns))
        lexicon.weights = _fit(x[["plain", "edited", "quoted"]].to_numpy(), x.toxic.to_numpy(np.float64), share)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1), ``n_terms``, ``n_edited`` and ``n_quoted`` of its whole text."""
    names = ("score", "n_terms", "n_edited", "n_quoted")
    kind = pa.struct([("score", pa.float64()), *((n, pa.int64()) for n in names[1:])])

    @F.arrow_udf("struct<score:double,n_terms:long,n_edited:long,n_quoted:long>")
    def score_texts(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(names, lexicon.score(x), strict=True)) for x in texts.to_pylist()], kind)

    scored = docs.drop(*names).withColumn("__toxicity", score_texts(F.col(text)))
    return scored.select(*(c for c in scored.columns if c != "__toxicity"), *(F.col(f"__toxicity.{n}").alias(n) for n in names))
