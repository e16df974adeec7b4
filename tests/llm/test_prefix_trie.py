"""Tries against a brute-force one, split on the cluster, in tasks, and both ways."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv_id].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, d == len(seq)))
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    least = {k: min(c for c, _ in v) for k, v in nodes.items()}
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c, e in v if e))).encode()).hexdigest() for k, v in nodes.items()}
    return sorted((least[k], len(k), least[k[:-1]] if k else None, len(v), len(children[k]), leaves[k], saved[k], ends[k]) for k, v in nodes.items())


def found(df):
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in df.dtypes) == prefix_trie.NODE
    return sorted(tuple(r) for r in df.collect())


def planted(seed=7, n=90):
    """Copies, shared prefixes, repeated turns, nulls, a long conversation and one without rows of its base."""
    rng, rows = random.Random(seed), []
    for c in range(0, n):
        if c in (5, 20):
            continue  # bases that are absent
        shared = rng.choice([0, 1, 3, 5])
        length = rng.randint(1, 14)
        for t in range(length):
            text = f"turn {t}" if t < shared else rng.choice([None, "", "é", f"{c} {t} {rng.random()}", "same"])
            rows.append((c, rng.choice([t, t, t, None]) if c % 9 == 0 else t, rng.choice([None, "", "user"]) if c % 7 == 0 else "user", text))
    rows += rows[:9] + [(None, 1, "user", "lost"), (None, None, None, None), (-3, 0, "user", "turn 0"), (-5, 0, "user", "turn 0")]
    rows += [(200, t, "user", f"long {t}") for t in range(250)] + [(c, t, "user", "turn 0") for c in range(300, 340) for t in range(2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [0, 60, 100_000])
def test_trie_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = planted()
    df = spark.createDataFrame(rows, ROWS).select("*", F.lit(1).alias("depth"), F.lit("x").alias("digest"))
    got = found(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_table(df)), small=small))
    assert got == brute(rows)


def test_few_and_no_conversations(spark):
    for rows in ([], [(None, 1, "a", "b")], [(7, 1, "user", "x")], [(6, None, None, None), (6, None, None, None)], [(3, 0, "a", "b"), (4, 0, "a", "b")]):
        df = spark.createDataFrame(rows, ROWS)
        for small in (0, 1000):
            assert found(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_table(df)), small=small)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(prefix_trie.op13_prefix_trie(spark, sf)) == brute(rows)


def test_long_lists_of_ends_are_streamed_in_order(spark):
    n = 3 * prefix_trie.CHUNK
    members = spark.range(n).repartition(7).select(F.lit(5).cast("long").alias("conv_id"), (F.col("id") % 2).alias("depth"), F.col("id").alias("member"))
    want = {d: hashlib.sha256(",".join(str(i) for i in range(d, n, 2)).encode()).hexdigest() for d in (0, 1)}
    assert {r.depth: r.ends_sha256 for r in prefix_trie.ends_of(members).collect()} == want
