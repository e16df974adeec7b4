import random

import corpus_pipeline
from matchloom.llm import nearcopies

SF = "/root/testdata/sf0.001"


def brute_roots(texts):
    """The smallest index of each group of connected texts."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_stage_equals_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(9):  # copies of copies, at similarities on both sides of the bound
            base = list(base)
            for _ in range(rng.randint(1, max(2, len(base) // 45))):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    want = brute_roots(texts)
    assert 12 < len(set(want)) < 100
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(want))


def test_rows_of_one_id_with_other_texts_stay(spark):
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, one), (1, other), (2, one), (1, one)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect())) == [(1, one), (1, other)]


def test_similarity_at_the_bound():
    words = [str(i).encode() for i in range(13)]  # 9 shingles; 8 of them in the shorter text
    a, b = nearcopies.shingles(words), nearcopies.shingles(words[:-1])
    assert nearcopies.jaccard(a, b) == 8 / 9
    assert nearcopies.jaccard(nearcopies.shingles([]), nearcopies.shingles([])) == 1


def test_close_pairs_hold_every_pair_at_the_bound(spark):
    """All pairs of one large group and of loose texts, whatever their roots were: none at the bound is left out, and
    texts that only edits of their own keep apart make no pairs."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(200), rng.choice((0, 1, 2, 3, 5, 8, 12))):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words[: rng.choice((200, 200, 180, 165))]))
    nodes = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, text string")
    got = {(r.a, r.b) for r in nearcopies.close_pairs(nodes.select("node", "root"), nodes.select("node", "text")).collect()}
    sets = [nearcopies.shingles(nearcopies._words(t)) for t in texts]
    want = {(i, j) for j in range(90) for i in range(j) if nearcopies.jaccard(sets[i], sets[j]) >= 0.8}
    assert want and want <= got and len(got) < 2 * len(want)
    far = [" ".join(f"own{i}x{at}" if at % 12 == 0 else w for at, w in enumerate(base)) for i in range(40)]
    nodes = spark.createDataFrame([(i, i, t) for i, t in enumerate(far)], "node long, root long, text string")
    assert nearcopies.close_pairs(nodes.select("node", "root"), nodes.select("node", "text")).count() == 0


def test_stage_on_empty_and_wordless_texts(spark, no_docs):
    assert corpus_pipeline.near_dedup(spark, no_docs, SF).count() == 0
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 4, 6]


def test_fingerprints_propose_pairs_without_any_band_key(spark):
    """SimHash is a step of its own: of three long texts, two differ in a word, and their fingerprints' links give that pair."""
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"z{i}" for i in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.sketches(docs)
    node = {r.doc_id: r.node for r in rows.collect()}
    got = [(r.a, r.b) for r in nearcopies.print_pairs(rows.select("node", "fp")).collect()]
    assert [{a, b} for a, b in got] == [{node[0], node[1]}]
