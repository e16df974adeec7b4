import random

import pytest
import xxhash

from matchloom.llm import simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: {node: unsigned fingerprint}; the smallest node of each component."""
    root = {n: n for n in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one two", "A b C d É f", "same same same same same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("dense", [0, 4, 10_000])
def test_links_lose_nothing(spark, dense):
    rng = random.Random(dense)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: c for i, c in enumerate(centres)}
    for _ in range(250):
        x = rng.choice(list(prints.values()))
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randint(0, 63)
        prints[len(prints)] = x
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in prints.items()}
    classes = spark.createDataFrame([(x,) for x in set(signed.values())], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(classes, dense)).collect()}
    groups: dict = {}
    for i, fp in signed.items():
        groups.setdefault(roots.get(fp, fp), []).append(i)
    want: dict = {}
    for i, r in brute_components(prints).items():
        want.setdefault(r, []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in brute_components(prints).items()}


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {r.doc_id: r.component_id for r in got if r.fp == 0}
    assert zero == {100: 100, 101: 100, 102: 100}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_take_links_in_either_direction(spark):
    edges = spark.createDataFrame([(9, 1), (9, 2), (3, 9), (5, 5), (8, 7)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {2: 1, 3: 1, 9: 1, 8: 7}
