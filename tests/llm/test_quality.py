import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import quality

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(W, text)
    tri = list(zip(w, w[1:], w[2:]))
    c = Counter(tri)
    hit = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(W, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(spark, odd_docs):
    name = "quality_rules_"  # the plain name is taken by an extra column
    got = quality.judge(odd_docs, quality.NO_FIELD).select("text", name).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        q = r[name]
        n, chars, symbols, dup, repeat = brute(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert q.base_failed == (n < 50 or 100 * repeat > 50 * n) and q.kept == (not q.base_failed)


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(30):
        field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = rng.integers(0, 2, (5, len(quality.FEATURES))).tolist()

        def score(y):
            s = field.start[y[0]] + sum((np.array(r) @ field.emit)[k] for r, k in zip(rows, y))
            return s + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        assert tuple(quality.viterbi(field, rows)) == max(product((0, 1), repeat=5), key=score)


def test_expectations_equal_sums_over_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    k = len(quality.FEATURES)
    docs = [(rng.integers(0, 2, (n, k)).astype(float), i % 2) for i, n in enumerate([1, 2, 3, 5, 4, 1])]
    sample, theta = quality._Sample(docs), rng.normal(size=2 * k + 6)
    emit, move, start = theta[: 2 * k].reshape(k, 2), theta[2 * k : -2].reshape(2, 2), theta[-2:]

    def counts(x, y):
        c = [np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)]
        for row, label in zip(x, y):
            c[0][:, label] += row
        for a, b in zip(y, y[1:]):
            c[1][a, b] += 1
        c[2][y[0]] += 1
        return np.concatenate([v.ravel() for v in c])

    logz, want, seen = 0.0, 0, 0
    for x, q in docs:
        every = [counts(x, y) for y in product((0, 1), repeat=len(x))]
        weights = np.exp([c @ theta for c in every])
        logz += np.log(weights.sum())
        want = want + sum(w * c for w, c in zip(weights, every)) / weights.sum()
        seen = seen + counts(x, [int(q == 0)] * len(x))
    got, have = sample.expected(theta)
    assert np.isclose(got, logz) and np.allclose(have, want) and np.allclose(sample.observed(), seen)


def test_lines_late_in_a_document_count():
    """Boilerplate that only ever comes after hundreds of plain lines is still learned."""
    plain = "A plain line of ordinary prose ends here."
    good = [(np.array(quality.text_lines("\n".join(f"{plain[:-1]} {i}." for i in range(300)))[0]), 1)] * 10
    bad = [(np.array(quality.text_lines("\n".join([f"{plain[:-1]} {i}." for i in range(300)] + ["BUY!! NOW!! %%% $$$ ### ***"] * 300))[0]), 0)] * 10
    field = quality.fit_field(good + bad)
    assert quality.viterbi(field, bad[0][0].tolist())[310:] == [1] * 290


def test_field_separates_junk_lines():
    good = [(np.array(quality.text_lines("A plain line of ordinary prose ends here.\n" * 1 + "Another line of prose follows it today.")[0]), 1)] * 20
    junk = [(np.array(quality.text_lines("A plain line of ordinary prose ends here.\n" + "BUY!! NOW!! %%% $$$ ### ***\n" * 4)[0]), 0)] * 20
    field = quality.fit_field(good + junk)
    assert quality.viterbi(field, junk[0][0].tolist())[1:] == [1, 1, 1, 1]
    assert quality.viterbi(field, good[0][0].tolist()) == [0, 0]


def test_a_long_sample_is_fitted_by_tasks(spark):
    """Parts of 40 lines, of one longer document or of several short ones, give the field that the driver's own fit gives."""
    plain, junk = "A plain line of ordinary prose ends here.", "BUY!! NOW!! %%% $$$ ### ***"
    rows = [(i, "\n".join([f"{plain[:-1]} {j}." for j in range(1 + i % 7 * 9)] + [junk] * (i % 2 * (2 + i % 5))), 1 - i % 2) for i in range(60)] + [(60, None, 1), (61, "", 0)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    here, spread = (quality.train(spark, docs, labels, fit_lines=n) for n in (quality.FIT_LINES, 40))
    for a, b in ((here.emit, spread.emit), (here.move, spread.move), (here.start, spread.start)):
        assert np.abs(a).max() > 0.1 and np.allclose(a, b, atol=1e-3)
    verdicts = [{(r.doc_id, r.q.content_share) for r in quality.judge(docs, f).select("doc_id", F.col("quality_rules").alias("q")).collect()} for f in (here, spread)]
    assert verdicts[0] == verdicts[1]


def test_nothing_to_learn_from(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(spark, odd_docs, labels) is quality.NO_FIELD
    assert quality.judge(no_docs, quality.NO_FIELD).count() == 0


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98
