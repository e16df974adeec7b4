"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned from labelled documents: whole words, and prefixes that stand for families of words, whose
counts in toxic and other documents differ by more than chance allows over all terms tried. Its trie is intersected
with Levenshtein automata (one error from five letters, two from ten; none for prefixes), so that misspelled terms are
caught; the product is made deterministic state by state as texts ask for it. Hits are weighed in a window around
them: quotation marks that enclose a hit, and other hits close by. A logistic regression over these window sums gives
the score.

Fitting uses at most about ``TRAIN_DOCS`` labelled documents outside the held-out fold, near copies counted once.
Defined results: null, empty and hit-free texts get the score of no hits. A null doc_id is not held out and never
learned from; repeated rows are scored row by row; without labelled rows of both kinds every score is 0. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import crc_fold, cut, map_batches, read_table

#: The bound of the fit: labelled documents used.
TRAIN_DOCS = 20_000
FOLDS, HELD_OUT = 5, 0
WINDOW = 8
PREFIXES = (4, 5, 6, 7)
#: Letters and digits, with the signs that disguises put between them or in front, so that id1ot and $cum stay whole.
_WORD = re.compile(r"[$@]?[^\W_]+(?:[$@!|*]+[^\W_]+)*")
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
N_FEATURES = 6


@dataclass
class Automaton:
    """Trie of terms x Levenshtein automata. Terms that end in ``*`` accept any word they begin."""

    weights: dict[str, float]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[str | None] = field(default_factory=lambda: [None])
    stems: list[str | None] = field(default_factory=lambda: [None])
    room: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        self._moves: list[dict[str, int]] = []
        self._accept: list[tuple[str, int] | None] = []
        self._stem: list[str | None] = []
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        for term in sorted(self.weights, key=lambda t: (len(t), t)):
            self._add(term)
        self.start = self._state(self._close({0: 0}))

    @staticmethod
    def errors(term: str) -> int:
        return 0 if term.endswith("*") else 2 if len(term) >= 10 else int(len(term) >= 5)

    def _add(self, term: str) -> None:
        node, path = 0, [0]
        for c in term.rstrip("*"):
            if self.stems[node]:
                return  # a shorter prefix already stands for it
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.stems.append(None)
                self.room.append(0)
            node = self.children[node][c]
            path.append(node)
        if term.endswith("*"):
            self.stems[node] = term
        else:
            self.ends[node] = term
        for n in path:
            self.room[n] = max(self.room[n], self.errors(term))

    def _close(self, best: dict[int, int]) -> frozenset:
        """Add what letters missing in the word allow; keep the fewest errors of each node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = best[node] + 1
                if e <= self.room[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        return frozenset(best.items())

    def _state(self, members: frozenset) -> int:
        if members not in self._states:
            self._states[members] = len(self._sets)
            self._sets.append(members)
            self._moves.append({})
            ends = [(e, self.ends[n]) for n, e in members if self.ends[n] and e <= self.errors(self.ends[n])]
            self._accept.append(None if not ends else (min(ends)[1], min(ends)[0]))
            self._stem.append(min((self.stems[n] for n, e in members if e == 0 and self.stems[n]), default=None))
        return self._states[members]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def put(node, e):
            if e <= self.room[node] and e < best.get(node, 99):
                best[node] = e

        for node, e in self._sets[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        to = self._state(self._close(best)) if best else -1
        self._moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that accepts a word, and its errors."""
        state, moves = self.start, self._moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
            if self._stem[state]:
                return self._stem[state], 0
        return self._accept[state]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    theta: np.ndarray


def quotations(text: str) -> list[tuple[int, int]]:
    """The quoted stretches of a text, in order and disjoint: on each line, an opening mark and the next closing one of its kind.

    A straight mark opens and closes in turn; a mark without a partner on its line quotes nothing.
    """
    found = []
    if any(a in text for a in _QUOTES):
        at = 0
        for line in text.split("\n"):
            for a, b in _QUOTES.items():
                start = line.find(a)
                while start >= 0 and (stop := line.find(b, start + 1)) >= 0:
                    found.append((at + start, at + stop))
                    start = line.find(a, stop + 1)
            at += len(line) + 1
    out: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _quoted(spans: list[tuple[int, int]], start: int, stop: int) -> bool:
    """Whether ``start`` to ``stop`` lies within one of the quoted stretches."""
    i = bisect_left(spans, (start + 1,))
    return i > 0 and stop <= spans[i - 1][1]


def features(text: str | None, automaton: Automaton, known: dict[str, tuple[str, int] | None]) -> list[float]:
    """Sums over the hits of a whole text: exact and misspelled ones, their weight, quoted ones, crowded windows, different terms.

    A quoted hit counts only as quoted.
    """
    if not text:
        return [0.0] * N_FEATURES
    text = text.lower()
    words = _WORD.findall(text)
    hits = {}
    for w in set(words):
        if w in known:
            m = known[w]
        else:
            if len(known) > 200_000:
                known.clear()
            m = known[w] = automaton.match(w)
        if m:
            hits[w] = m
    if not hits:
        return [0.0] * N_FEATURES
    exact = fuzzy = weight = quoted = crowded = 0.0
    meant: set[str] = set()
    last, spans = -WINDOW - 1, quotations(text)
    for i, m in enumerate(_WORD.finditer(text)):
        if m[0] not in hits:
            continue
        term, errors = hits[m[0]]
        if _quoted(spans, *m.span()):
            quoted += 1
            continue
        if not errors:
            meant.add(term)
        exact += errors == 0
        fuzzy += errors > 0
        weight = max(weight, automaton.weights[term] * 0.5**errors)
        crowded += i - last <= WINDOW
        last = i
    return [float(np.log1p(exact)), float(np.log1p(fuzzy)), weight, float(np.log1p(quoted)), float(np.log1p(crowded)), float(np.log1p(len(meant)))]


def terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def sketch(text: str) -> int:
    """A min-hash of word triples: near copies mostly agree on it."""
    words = _WORD.findall(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, other: int, tried: int) -> dict[str, float]:
    """Terms far more frequent in toxic documents than chance allows over all terms tried (a likelihood-ratio test), with log odds."""
    floor, out = 2 * np.log(max(tried, 2)) + 2, {}
    for term, t, o in counts:
        p1, p2, p = t / toxic, o / other if other else 0.0, (t + o) / (toxic + other)
        if p1 <= 5 * p2:
            continue

        def ll(k, n, q):
            return (k * np.log(q) if k else 0.0) + ((n - k) * np.log(1 - q) if n > k else 0.0)

        g = 2 * (ll(t, toxic, p1) + ll(o, other, p2) - ll(t, toxic, p) - ll(o, other, p))
        if g >= floor:
            out[term] = float(np.log((t + 0.5) / (toxic + 1)) - np.log((o + 0.5) / (other + 1)))
    return dict(sorted(out.items()))


def fit_logistic(X: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps on the penalised likelihood."""
    X = np.column_stack([X, np.ones(len(X))])
    theta = np.zeros(X.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(X @ theta, -30, 30)))
        g = X.T @ (p - y) / len(y) + l2 * theta
        H = (X * (p * (1 - p))[:, None]).T @ X / len(y) + l2 * np.eye(len(theta))
        theta -= np.linalg.solve(H, g)
    return theta


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model | None:
    """Fit lexicon and weights on labelled rows outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    if not n:
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000))
    picked = marked.where(u < int(1_000_000 * min(1.0, most / n)) + 1).select(F.col("doc_id").alias("i"), "toxic")
    sample = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("i")).select("doc_id", "text", "toxic")

    def sketches(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t or "") for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], names=["doc_id", "sketch", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    firsts = map_batches(sample, sketches, f"doc_id {kind}, sketch long, toxic int").groupBy("sketch", "toxic").agg(F.min("doc_id").alias("i"))
    chosen = sorted((r.i, r.toxic) for r in firsts.collect())  # at most the sample's ids
    toxic = sum(t for _, t in chosen)
    if not 0 < toxic < len(chosen):
        return None
    spark = docs.sparkSession
    kept = spark.createDataFrame(chosen, f"i {kind}, toxic int")
    fit = docs.join(F.broadcast(kept), F.col("doc_id") == F.col("i")).select("text", "toxic")

    def count(batches):
        found: dict[str, list[int]] = {}

        def out():
            rows = list(found.items())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())], names=["term", "t", "o"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term in terms(text or ""):
                    found.setdefault(term, [0, 0])[1 - label] += 1
                if len(found) > 300_000:
                    yield out()
                    found.clear()
        yield out()

    counts = map_batches(fit, count, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = cut(counts)
    tried = counts.count()
    likely = counts.where((F.col("t") >= 4) & (F.col("t") * (len(chosen) - toxic) > 5 * F.col("o") * toxic))  # bounded by the sample's words
    lexicon = choose_terms([(r.term, r.t, r.o) for r in likely.collect()], toxic, len(chosen) - toxic, tried)

    def featurise(batches):
        automaton, known = Automaton(lexicon), {}
        for b in batches:
            rows = [features(t, automaton, known) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sorted((list(r.x), r.y) for r in map_batches(fit, featurise, "x array<double>, y int").collect())
    return Model(lexicon, fit_logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        automaton, known = Automaton(model.lexicon if model else {}), {}
        for b in batches:
            texts = b.column(1).to_pylist()
            if model is None:
                p = np.zeros(len(texts))
            else:
                X = np.array([features(t, automaton, known) for t in texts]).reshape(-1, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(X @ model.theta[:-1] + model.theta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
