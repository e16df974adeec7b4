from collections import Counter

import pytest
import tiktoken

from matchloom.llm import bpe
from matchloom.llm import token_rollup as roll
from matchloom.llm.common import Store, shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
ORACLE = tiktoken.Encoding("oracle", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.public_ranks(), special_tokens={})
DDL = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"


@pytest.fixture
def store(spark):
    return Store(spark, shared_dir(spark))


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.totals(store).collect()}


def test_signed_batches_replays_and_compaction(spark, store):
    assert totals(store) == {}
    a = spark.createDataFrame([("s", "en", "v1", "insert", 10, None), ("s", "en", "v1", "insert", 5, None), (None, None, None, "insert", None, None)], DDL)
    b = spark.createDataFrame([("s", "en", "v1", "revise", 12, 10), ("s", "en", "v1", "delete", 5, None)], DDL)
    assert roll.commit(store, "a", a) and roll.commit(store, "b", b)
    want = {("s", "en", "v1"): (1, 12), (None, None, None): (1, 0)}
    assert totals(store) == want
    assert not roll.commit(store, "b", b) and totals(store) == want
    assert roll.compact(store, "ab") and list(store.batches()) == ["ab"] and totals(store) == want
    assert not roll.commit(store, "a", a) and totals(store) == want  # a compacted batch counts as committed
    assert roll.commit(store, "c", spark.createDataFrame([("s", "en", "v1", "delete", 12, None)], DDL))
    assert totals(store) == {(None, None, None): (1, 0)}
    assert roll.commit(store, "d", spark.createDataFrame([], DDL)) and len(totals(store)) == 1


def test_a_batch_that_fails_is_never_read(spark, store):
    good = spark.createDataFrame([("s", "en", "v1", "insert", 10, None)], DDL)
    roll.commit(store, "a", good)
    with pytest.raises(Exception):
        roll.commit(store, "b", good.selectExpr("raise_error('lost') as source", "lang", "tokenizer", "op", "n_tokens", "old_tokens"))
    assert totals(store) == {("s", "en", "v1"): (1, 10)}
    assert roll.commit(store, "b", good) and totals(store) == {("s", "en", "v1"): (2, 20)}


def test_batch_ids_are_plain(spark, store):
    with pytest.raises(ValueError):
        roll.commit(store, "../x", spark.createDataFrame([], DDL))


def brute(rows):
    docs, tokens, firsts = Counter(), Counter(), {}
    for r in rows:
        if r.doc_id is not None:
            firsts[r.text or ""] = min(firsts.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        t = r.text or ""
        if r.doc_id is not None and r.doc_id > firsts[t]:
            continue
        for name, n in ((roll.BPE, len(ORACLE.encode_ordinary(t))), (roll.WORDS, len(t.encode().split()))):
            docs[r.source, r.lang, name] += 1
            tokens[r.source, r.lang, name] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def through_query(spark, docs):
    root = shared_dir(spark)
    docs.write.parquet(f"{root}/documents.parquet")
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.op10_token_rollup(spark, root).collect()}


def test_query_equals_brute_force(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.op10_token_rollup(spark, sf).collect()}
    assert got == brute(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert through_query(spark, odd_docs) == brute(odd_docs.collect())
    assert through_query(spark, no_docs) == {}


def test_a_batch_committed_during_compaction_is_kept(spark, monkeypatch):
    """10 tokens, then 5 that are published after compaction took its snapshot: 15."""
    store = Store(spark, shared_dir(spark))
    one = lambda n: spark.createDataFrame([("s", "en", "t", "insert", n, None)], "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")
    roll.commit(store, "a", one(10))
    plain = roll.totals

    def late(*args):
        out = plain(*args)
        roll.commit(store, "b", one(5))
        return out

    monkeypatch.setattr(roll, "totals", late)
    assert roll.compact(store, "ab")
    assert [(r.n_docs, r.n_tokens) for r in plain(store).collect()] == [(2, 15)] and set(store.batches()) == {"ab", "b"}
