"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into ``DIM`` features. Document frequencies are counted over every
learnable document. The weights are trained by follow-the-regularised-leader with elastic-net penalties on a bounded
sample (at most about ``PER_CLASS`` documents of each language), a part of which is kept back to fit the softmax
temperature.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned. Rows without a doc_id are predicted but never learned from, and are not held out. Repeated rows are predicted
row by row; equal scores go to the alphabetically first language. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import crc_fold, map_batches, read_table

BITS = 15
DIM = 1 << BITS
#: Bounds of the training sample: documents of one language, and of all languages together. A document is at most DIM
#: pairs of a feature and its count, compressed.
PER_CLASS, SAMPLE = 800, 8000
FOLDS, HELD_OUT, EPOCHS = 4, 2, 3
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is among the text's."""
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the whole lower-cased text, in pieces so that long texts need little memory."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(codes), 1 << 18):
        piece = codes[at : at + (1 << 18) + 2]
        one = piece * _MIX[0]
        two = one[:-1] + piece[1:] * _MIX[1]
        parts = [one[: 1 << 18], two[: 1 << 18], (two[:-1] ^ (piece[2:] * _MIX[2]))[: 1 << 18]]
        for salt, h in enumerate(parts):
            h = (h ^ (h >> np.uint32(15))) * _MIX[salt]
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
    return counts


def tfidf(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf[index]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def fit_ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over rows of (feature indices, values, class)."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for index, value, y in rows:
        i, x = np.append(index, DIM), np.append(value, 1.0)
        zi, ni = z[i], n[i]
        w = weights(zi, ni)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1.0
        g = x[:, None] * p
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[i] = zi + g - sigma * w
        n[i] = ni + g * g
    w = weights(z, n)
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log-loss on kept-back rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 80))

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y])

    return float(min(grid, key=loss))


def train(docs: DataFrame, per_class: int = PER_CLASS, sample: int = SAMPLE) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside the held-out fold that have a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    classes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not classes:
        return None
    names = sorted(classes)
    share = {c: min(1.0, min(per_class, sample / len(names)) / classes[c]) for c in names}

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += ngram_counts(t) > 0
                n += 1
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(df[i], n), pa.int64())], names=["f", "n"])

    counts = map_batches(rows.select("text"), frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # at most DIM + 1 rows
    total, df = next(r.n for r in counts if r.f < 0), np.zeros(DIM)
    for r in counts:
        if r.f >= 0:
            df[r.f] = r.n
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)

    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_000))
    limit = F.lit(0)
    for c in names:
        limit = F.when(F.col("lang") == c, int(share[c] * 1_000_000) + 1).otherwise(limit)
    picked = rows.select(u.alias("u"), "lang", "text", limit.alias("most")).where("u < most").select("u", "lang", "text")

    def featurise(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            xs = []
            for t in b.column(2).to_pylist():
                c = ngram_counts(t)
                i = np.flatnonzero(c)
                xs.append(squeeze.compress(np.stack([i, c[i]]).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], names=["u", "lang", "x"])

    got = sorted((r.u, r.lang, bytes(r.x)) for r in map_batches(picked, featurise, "u long, lang string, x binary").collect())
    ready = [_Row(x, names.index(lang)) for _, lang, x in got]
    keep, fit = ready[::5], [r for k, r in enumerate(ready) if k % 5] or ready
    w, b = fit_ftrl((r.open(idf) for _ in range(EPOCHS) for r in fit), len(names))
    kept = [r.open(idf) for r in keep]
    logits = np.array([v @ w[i] + b for i, v, _ in kept])
    return Model(names, idf.astype(np.float32), w.astype(np.float32), b, fit_temperature(logits, np.array([y for *_, y in kept])))


@dataclass(frozen=True)
class _Row:
    """A document of the sample, unpacked only while it is learned from."""

    packed: bytes
    label: int

    def open(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        i, c = np.frombuffer(zstandard.decompress(self.packed), "<u4").reshape(2, -1).astype(np.int64)
        return i, tfidf(i, c, idf), self.label


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x classes floats

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for t in b.column(1).to_pylist():
                if m is None or t is None or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                c = ngram_counts(t)
                i = np.flatnonzero(c)
                s = (tfidf(i, c[i], m.idf) @ m.weights[i] + m.bias) / m.temperature
                p = np.exp(s - s.max())
                langs.append(m.classes[int(p.argmax())])
                scores.append(float(min(1.0, p.max() / p.sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
