import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from matchloom.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op9_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_undetermined_and_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = {(r.doc_id): r for r in langid.identify(odd_docs, model).collect()}
    assert len(langid.identify(odd_docs, model).collect()) == odd_docs.count()
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[0].lang_pred in ("de", "en")
    assert langid.train(no_docs) is None and langid.identify(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_counts_do_not_depend_on_pieces():
    """Texts around and beyond one piece of 2^18 characters count as a plain loop does."""
    for text in ("", "a", "ab", "Mañana über", "xyz" * 87_500 + "q"):
        assert (langid.ngram_counts(text) == naive_counts(text)).all()


def naive_counts(text):
    """Hashed n-grams one by one, with plain integers."""
    c, mask = [ord(x) for x in text.lower()], 0xFFFFFFFF
    m1, m2, m3 = 2654435761, 2246822519, 3266489917
    found = Counter()
    for i in range(len(c)):
        one = c[i] * m1 & mask
        grams = [one]
        if i + 1 < len(c):
            grams.append(one + (c[i + 1] * m2 & mask) & mask)
        if i + 2 < len(c):
            grams.append(grams[1] ^ (c[i + 2] * m3 & mask))
        for h, m in zip(grams, (m1, m2, m3)):
            found[((h ^ h >> 15) * m & mask) >> 17] += 1
    out = np.zeros(langid.DIM, np.int64)
    for k, n in found.items():
        out[k] = n
    return out


def brute(rows):
    """The whole method in plain Python, row by row: what the query must predict for each (doc_id, text, lang)."""
    learn = [r for r in rows if r.doc_id is not None and r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names = sorted({r.lang for r in learn})
    counts = {t: {int(i): int(c[i]) for i in np.flatnonzero(c)} for t in {r.text for r in rows if r.text} for c in [naive_counts(t)]}
    counts[""] = {}
    df = Counter(f for r in learn for f in counts[r.text])
    idf = {f: math.log((1 + len(learn)) / (1 + n)) + 1 for f, n in df.items()}

    def vector(text):
        x = {f: math.log1p(n) * idf.get(f, 0.0) for f, n in counts[text].items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / norm for f, v in x.items()} if norm else x

    hashes = {}
    for r in learn:
        hashes.setdefault(r.doc_id, SPARK_HASH(r.doc_id))
    order = sorted(learn, key=lambda r: (hashes[r.doc_id], r.lang))
    keep, fit = order[::5], [r for k, r in enumerate(order) if k % 5]
    z, n = [defaultdict(float) for _ in names], [defaultdict(float) for _ in names]
    alpha, beta, l1, l2 = 2.0, 1.0, 2e-3, 1e-3

    def weight(k, f):
        zi = z[k][f]
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(n[k][f])) / alpha + l2)

    def softmax(s, t=1.0):
        e = [math.exp((v - max(s)) / t) for v in s]
        return [v / sum(e) for v in e]

    for _ in range(3):
        for r in fit:
            x = {**vector(r.text), "bias": 1.0}
            w = [{f: weight(k, f) for f in x} for k in range(len(names))]
            p = softmax([sum(v * w[k][f] for f, v in x.items()) for k in range(len(names))])
            for k, name in enumerate(names):
                for f, v in x.items():
                    g = v * (p[k] - (name == r.lang))
                    sigma = (math.sqrt(n[k][f] + g * g) - math.sqrt(n[k][f])) / alpha
                    z[k][f] += g - sigma * w[k][f]
                    n[k][f] += g * g

    def logits(text):
        x = {**vector(text), "bias": 1.0}
        return [sum(v * weight(k, f) for f, v in x.items()) for k in range(len(names))]

    kept = [(logits(r.text), names.index(r.lang)) for r in keep]
    grid = [math.exp(math.log(0.05) + i * (math.log(5.0) - math.log(0.05)) / 79) for i in range(80)]
    best = min(grid, key=lambda t: sum(-math.log(softmax(s, t)[y]) for s, y in kept))
    out = []
    for r in rows:
        if not r.text or not any(unicodedata.category(c).startswith("L") for c in r.text):
            out.append((r.doc_id, "und", 0.0))
        else:
            p = softmax(logits(r.text), best)
            out.append((r.doc_id, names[p.index(max(p))], max(p)))
    return out


def test_query_equals_brute_force(spark):
    global SPARK_HASH
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(60)
    rows = docs.collect()
    u = {r.doc_id: r.u for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_000)).alias("u")).collect()}
    SPARK_HASH = u.get
    rows = [*rows, Row(doc_id=9001, text="² ½ ① Ⅷ 123", lang=None), Row(doc_id=9002, text=None, lang=None), Row(doc_id=9003, text="", lang=None)]
    some = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(some, langid.train(some)).collect()}
    for i, lang, score in brute(rows):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, i
