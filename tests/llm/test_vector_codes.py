"""Codes and codebooks against a plain loop in whole numbers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import vector_codes
from matchloom.llm.common import shared_dir

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    books = [[r[1][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(4)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            groups = [[] for _ in books[p]]
            for _, v, _ in kept:
                groups[near(p, v[p * width : (p + 1) * width])[1]].append(v[p * width : (p + 1) * width])
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, books[p])])
        books = new
    out, by_label = [], {}
    for i, v, lab in kept:
        best = [near(p, v[p * width : (p + 1) * width]) for p in range(4)]
        out.append([i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), lab])
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, by_label[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out), key=repr)


def planted(n=400):
    rng = random.Random(3)
    rows = [(rng.choice([i, i, i + 1]), [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [rows[0], rows[0], (None, [0.125] * 8, 1), (2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [0.1] * 7 + [float("nan")], 0), (2003, [float("inf")] + [0.0] * 7, 0)]
    return rows


def query(spark, rows):
    root = shared_dir(spark)
    spark.createDataFrame(rows, ROWS).select("*", F.lit(1).alias("code"), F.lit(2).alias("v")).write.parquet(f"{root}/embeddings.parquet")
    df = vector_codes.op12_vector_codes(spark, root)
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in df.dtypes) == vector_codes.CODES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, lab) for i, v, lab in planted()]
    assert query(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    for rows in ([(5, [0.5] * 4, None), (5, [0.5] * 4, None), (6, [0.25] * 4, 1)], [(1, [1.0, 2.0, 3.0, 4.0], 0)]):
        assert query(spark, rows) == brute(rows)
    assert query(spark, []) == [] and query(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("rows", [[(1, [0.0] * 4, 0), (2, [0.0] * 8, 0)], [(1, [0.0] * 6, 0)], [(1, [1e30] * 4, 0)], [(1, [], 0)]])
def test_vectors_without_an_answer_are_errors(spark, rows):
    with pytest.raises(Exception, match="components|component"):
        query(spark, rows)


def test_tree_visits_equal_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        entries = rng.integers(-3, 4, (200, 3))
        queries = rng.integers(-4, 5, (500, 3))
        d = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        found, best = vector_codes.KdTree(entries).nearest(queries)
        assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_decoding_gives_the_entries(spark):
    df = spark.createDataFrame([(i, [i / 64] * 4, 0) for i in range(20)], ROWS)
    codes, books = vector_codes.compress(df)
    got = {r.vec_id: r.vector for r in vector_codes.decode(codes, books).collect()}
    assert got == {i: [i / 64] * 4 for i in range(20)}
