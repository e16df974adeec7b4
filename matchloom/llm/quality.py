"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Every line with a word gets a label, content or boilerplate, by Viterbi decoding; a document is kept when
the share of its word characters that lies in content lines reaches a threshold and no base rule fails.

Defined results: a null or empty text has no words, so it fails the base rule of 50 words. Repeated rows and
ties are judged row by row, a null doc_id is passed through, extra columns are never read. Without labelled
rows the field has no parameters and every line counts as content.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import cut, fresh_name, map_batches, read_table

#: The bound of the labelled sample the field is fitted on. All lines of its documents count; a line is two bytes there.
TRAIN_DOCS = 3000
#: Up to so many lines the driver fits the sample itself; a longer one is laid out in parts of about as many lines, whose
#: expectations tasks sum, so that documents of any length can be learned from. Both give the same field up to rounding.
FIT_LINES = 200_000
#: A document is kept from this content share on.
KEEP_SHARE = 0.5
FEATURES = (
    "bias", "symbols", "many_symbols", "capitals", "exclamations", "pipes", "repeat_of_earlier", "few_words", "many_words",
    "sentence_end", "dominant_word", "digits", "repeated_windows", "long_words",
)
_SYMBOLS = b"#*$%&|<>"
_BITS = 1 << np.arange(len(FEATURES))


@dataclass(frozen=True)
class Field:
    """Emission weights (features x 2), transition weights (2 x 2) and start weights (2); label 1 is boilerplate."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


NO_FIELD = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.array([1.0, 0.0]))


def line_features(line: str, words: list[bytes], seen: bool) -> list[float]:
    """Indicators of one line that has at least one word."""
    n, chars = len(words), sum(map(len, words))
    raw = line.encode()
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
    windows = list(zip(words, words[1:], words[2:]))
    return [
        1.0,
        float(symbols >= 0.1 * n and symbols > 1),
        float(symbols >= 0.5 * n),
        float(upper > 0.6 * (upper + lower) and n > 1),
        float(line.count("!") >= 0.3 * n),
        float(line.count("|") >= 0.3 * n),
        float(seen),
        float(n < 4),
        float(n > 60),
        float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
        float(n >= 8 and max(Counter(words).values()) >= 0.3 * n),
        float(sum(map(str.isdigit, line)) >= 0.3 * chars),
        float(n >= 8 and len(set(windows)) < 0.7 * len(windows)),
        float(chars > 14 * n),
    ]


def text_lines(text: str) -> tuple[list[list[float]], list[int], int]:
    """Features and word bytes of each line with a word, and how many lines equal an earlier one."""
    rows, weights, repeats, before = [], [], 0, set()
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            continue
        seen = line in before
        repeats += seen
        before.add(line)
        rows.append(line_features(line, words, seen))
        weights.append(sum(map(len, words)))
    return rows, weights, repeats


def base_counts(text: str) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols and n_repeat_words of a text; words end at the six ASCII white spaces."""
    raw = text.encode()
    words = raw.split()
    chars = len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    windows = list(zip(words, words[1:], words[2:]))
    hit = 0
    if len(set(windows)) < len(windows):
        many = Counter(windows)
        until = 0
        for i, w in enumerate(windows):
            if many[w] > 1:
                hit += i + 3 - max(i, until)
                until = i + 3
    return len(words), chars, symbols, hit


def viterbi(field: Field, rows) -> list[int]:
    """The likeliest labels of a document's lines; ties go to content."""
    if not len(rows):
        return []
    score = np.asarray(rows) @ field.emit
    (a, b), ((cc, cb), (bc, bb)) = score[0] + field.start, field.move
    back = []
    for c, d in score[1:].tolist():
        from_b0, from_b1 = b + bc > a + cc, b + bb > a + cb
        back.append((from_b0, from_b1))
        a, b = c + (b + bc if from_b0 else a + cc), d + (b + bb if from_b1 else a + cb)
    label = int(b > a)
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return labels[::-1]


class _Sample:
    """Labelled documents as runs of line patterns, padded in groups of like length (at most twice the shortest)."""

    def __init__(self, docs: list[tuple[np.ndarray, int]], labels: list[np.ndarray] | None = None):
        """``docs`` are (line features, quality); ``labels`` those of their lines, by the quality where they are not given."""
        every = np.concatenate([x for x, _ in docs]).astype(np.int64) @ _BITS
        known, flat = np.unique(every, return_inverse=True)  # the different lines, fewer than there are lines
        self.X = (known[:, None] & _BITS > 0).astype(float)
        ends = np.cumsum([len(x) for x, _ in docs])
        self.codes = np.split(flat.ravel(), ends[:-1])
        self.bad = np.array([q == 0 for _, q in docs])
        self.Y = labels or [np.full(len(c), int(b)) for c, b in zip(self.codes, self.bad)]
        size = np.array([len(c) for c in self.codes])
        self.total, self.groups = size.sum(), []
        for k in np.unique(np.log2(size).astype(int)):
            ids = np.flatnonzero(np.log2(size).astype(int) == k)
            live = np.arange(size[ids].max())[:, None] < size[ids]  # time first: a step reads one row
            code = np.zeros(live.shape, np.int64)
            for j, i in enumerate(ids):
                code[: size[i], j] = self.codes[i]
            self.groups.append((ids, live, code))

    def observed(self) -> np.ndarray:
        """Counts of pattern and label, of label pairs and of first labels."""
        emit, move, start = np.zeros((len(self.X), 2)), np.zeros((2, 2)), np.zeros(2)
        for c, y in zip(self.codes, self.Y):
            np.add.at(emit, (c, y), 1)
            np.add.at(move, (y[:-1], y[1:]), 1)
            start[y[0]] += 1
        return np.concatenate([(self.X.T @ emit).ravel(), move.ravel(), start])

    def expected(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of log partition functions and its gradient, by scaled forward and backward passes."""
        k = len(FEATURES)
        emit, move, start = theta[: 2 * k].reshape(k, 2), np.exp(theta[2 * k : 2 * k + 4].reshape(2, 2)), np.exp(theta[2 * k + 4 :])
        S = self.X @ emit
        top = S.max(1, keepdims=True)
        E, logz = np.exp(S - top), 0.0
        of_pattern, of_move, of_start = np.zeros((len(self.X), 2)), np.zeros((2, 2)), np.zeros(2)
        for _, live, code in self.groups:
            e = E[code]
            T, n = live.shape
            A, B, C = np.empty((T, n, 2)), np.ones((T, n, 2)), np.ones((T, n))
            a = e[0] * start
            C[0] = a.sum(1)
            A[0] = a / C[0][:, None]
            for t in range(1, T):
                a = (A[t - 1] @ move) * e[t]
                c = a.sum(1)
                on = live[t]
                C[t] = np.where(on, c, 1.0)
                A[t] = np.where(on[:, None], a / c[:, None], A[t - 1])
            for t in range(T - 2, -1, -1):
                b = (e[t + 1] * B[t + 1]) @ move.T / C[t + 1][:, None]
                B[t] = np.where(live[t + 1][:, None], b, 1.0)
            logz += np.log(C).sum() + top[code][..., 0][live].sum()
            P = (A * B)[live]
            np.add.at(of_pattern, code[live], P / P.sum(1, keepdims=True))
            both = live[1:]
            right = (e[1:] * B[1:] / C[1:][..., None])[both]
            of_move += move * (A[:-1][both].T @ right)
            first = A[0] * B[0]
            of_start += (first / first.sum(1, keepdims=True)).sum(0)
        return float(logz), np.concatenate([(self.X.T @ of_pattern).ravel(), of_move.ravel(), of_start])


    def relabel(self, field: Field) -> None:
        """Lines of bad documents that the field takes for content count as that."""
        for i in np.flatnonzero(self.bad):
            self.Y[i] = np.array(viterbi(field, self.X[self.codes[i]]))


def _unpacked(x: bytes) -> np.ndarray:
    """Line features from two bytes a line."""
    return (np.frombuffer(x, "<u2")[:, None] & _BITS > 0).astype(np.int64)


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[_Sample]:
    """Samples of at most ``most`` lines, or of one longer document, from rows (x, q, y)."""
    docs, labels, size = [], [], 0
    for x, q, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
        if size and size + len(y) > most:
            yield _Sample(docs, labels)
            docs, labels, size = [], [], 0
        docs.append((_unpacked(x), q))
        labels.append(np.frombuffer(y, np.uint8).astype(np.int64))
        size += len(y)
    if docs:
        yield _Sample(docs, labels)


class _SpreadSample:
    """As ``_Sample``, over rows (x, q, y: two bytes of features a line, the quality, a byte a line for its label) in the
    shared folder. A task sums what its documents give, so the driver sees one vector of sums a task."""

    def __init__(self, rows: DataFrame, lines: int, part: int):
        self.total, self.part = lines, part
        self.rows = cut(rows.repartition(-(-lines // part)))

    def _sum(self, of: Callable[[_Sample], np.ndarray]) -> np.ndarray:
        most = self.part

        def run(batches):
            sums = [of(sample) for b in batches for sample in _chunks(b, most)]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tolist()])], names=["v"])

        # exactly rounded sums, so the order in which tasks end doesn't matter
        return np.array([math.fsum(c) for c in zip(*(r.v for r in map_batches(self.rows, run, "v array<double>").collect()))])

    def observed(self) -> np.ndarray:
        return self._sum(lambda sample: sample.observed())

    def expected(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        def both(sample):
            logz, have = sample.expected(theta)
            return np.concatenate([[logz], have])

        v = self._sum(both)
        return float(v[0]), v[1:]

    def relabel(self, field: Field) -> None:
        def run(batches):
            for b in batches:
                ys = [y if q else bytes(viterbi(field, _unpacked(x))) for x, q, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ys, pa.binary())], names=["x", "q", "y"])

        self.rows = cut(map_batches(self.rows, run, "x binary, q int, y binary"))


def fit_field(docs: list[tuple[np.ndarray, int]]) -> Field:
    """Fit on (line features, quality) of labelled documents; without good or without bad ones there is nothing to learn."""
    docs = [(np.asarray(x), q) for x, q in docs if len(x)]
    if not any(q == 0 for _, q in docs) or not any(q == 1 for _, q in docs):
        return NO_FIELD
    return _fit(_Sample(docs))


def _fit(sample: _Sample | _SpreadSample, rounds: int = 2, l2: float = 1e-3) -> Field:
    """Lines of good documents are content. Those of bad ones start as boilerplate; after each round the lines that
    the field itself takes for content are relabelled, so that ordinary lines of bad documents stop counting.
    """
    k = len(FEATURES)
    theta = np.zeros(2 * k + 6)
    for i in range(rounds):
        theta = _descend(sample, theta, l2)
        field = Field(theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :])
        if i < rounds - 1:
            sample.relabel(field)
    return field


def _descend(sample: _Sample | _SpreadSample, theta: np.ndarray, l2: float, most: int = 100, memory: int = 8) -> np.ndarray:
    """The least penalised negative log-likelihood a line, by L-BFGS steps until the gradient is small."""
    seen = sample.observed()

    def loss(x):
        logz, have = sample.expected(x)
        return (logz - seen @ x) / sample.total + l2 * (x @ x) / 2, (have - seen) / sample.total + l2 * x

    f, g = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.abs(g).max() < 1e-5:
            break
        q, back = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        rate = 1.0 if steps else min(1.0, 1 / np.abs(g).sum())
        while True:
            new = theta - rate * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * rate * (g @ q) or rate < 1e-8:
                break
            rate /= 2
        s, y = new - theta, g2 - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        theta, f, g = new, f2, g2
        if rate < 1e-8:
            break
    return theta


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, fit_lines: int = FIT_LINES) -> Field:
    """Fit the field on at most about ``max_docs`` labelled documents, picked evenly by a hash of their ids.

    Only line features of that sample reach the driver, as one bit each, never texts, and only if they are of at most
    ``fit_lines`` lines; the features of a longer sample stay in tasks.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = labels.withColumn("u", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_000)))
    n = labels.count()
    if not n:
        return NO_FIELD
    chosen = labels.where(F.col("u") < int(1_000_000 * min(1.0, max_docs / n)) + 1).select(F.col("doc_id").alias("i"), "quality")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).select("text", "quality")

    def featurise(batches):
        for b in batches:
            xs = [(np.asarray(text_lines(t or "")[0], int).reshape(-1, len(FEATURES)) @ _BITS).astype("<u2").tobytes() for t in b.column(0).to_pylist()]
            qs = b.column(1).cast(pa.int32())
            ys = [bytes([q == 0]) * (len(x) // 2) for x, q in zip(xs, qs.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), qs, pa.array(ys, pa.binary())], names=["x", "q", "y"])

    rows = cut(map_batches(sample, featurise, "x binary, q int, y binary").where("length(y) > 0"))
    size = rows.agg(F.sum(F.length("y")).alias("lines"), F.count_if(F.col("q") == 0).alias("bad"), F.count_if(F.col("q") == 1).alias("good")).first()
    if not size.bad or not size.good:
        return NO_FIELD
    if size.lines > fit_lines:
        return _fit(_SpreadSample(rows, size.lines, fit_lines))
    return fit_field([(_unpacked(x), q) for x, q in sorted((bytes(r.x), r.q) for r in rows.select("x", "q").collect())])


def judge(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """``docs`` with one struct column ``quality_rules`` (renamed if taken): counts, content share and the verdict."""
    name = fresh_name(docs, "quality_rules")
    parts = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    ddl = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,content_share:double,base_failed:boolean,kept:boolean>"
    at = docs.columns.index("text")

    def verdicts(batches):
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                t = t or ""
                n, chars, symbols, repeat = base_counts(t)
                rows, weights, dup = text_lines(t)
                total = sum(weights)
                content = sum(w for w, y in zip(weights, viterbi(field, rows)) if y == 0)
                share = content / total if total else 0.0
                failed = n < 50 or 100 * repeat > 50 * n
                out.append((n, chars, symbols, dup, repeat, share, failed, not failed and share >= keep_share))
            cols = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*out) if out else [[]] * len(parts), parts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, names=[p for p, _ in parts])], names=[*b.schema.names, name])

    return map_batches(docs, verdicts, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(ddl))]))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(spark, docs, read_table(spark, sf_dir, "labels"))
    q = "quality_rules."
    return judge(docs, field).select("doc_id", *(q + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")))
