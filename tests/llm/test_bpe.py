import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.public_ranks()
ORACLE = tiktoken.Encoding("oracle", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab's \t\n\r\x0b\x1c\x1f\x85\xa0é²½ß一1١Ⅷ 　​!?_\U0001f642ɏɐ"), max_size=40))
def test_pieces_give_the_librarys_ids(text):
    merge = bpe.encoding(RANKS).encode_ordinary
    assert [i for p in bpe.pretokens(text) for i in merge(p)] == ORACLE.encode_ordinary(text)


def brute_merge(piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("word", [" reconnoitring", "éeuxmentre", "Zzzzyx", "\U0001f642" * 3, "a" * 40])
def test_merges_follow_the_ranks(word):
    assert bpe.encoding(RANKS).encode_ordinary(word) == brute_merge(word.encode())


def same_rows(got, want):
    key = lambda i, ids, text: (repr(i), tuple(ids), bytes(text))
    assert sorted(key(r.doc_id, r.token_ids, r.decoded) for r in got) == sorted(key(r.doc_id, ORACLE.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in want)


@pytest.mark.parametrize("small", [True, False])
def test_whole_round_trip(spark, odd_docs, small, monkeypatch):
    if small:
        for name, most in (("BLOCK_CHARS", 500), ("CHUNK_IDS", 100), ("ANSWERS", 30)):
            monkeypatch.setattr(bpe, name, most)
    want = odd_docs.select("doc_id", "text").collect()
    same_rows(bpe.decode(bpe.encode(odd_docs, RANKS), RANKS).collect(), want)
    same_rows(bpe.decode_chunks(bpe.encode_chunks(odd_docs, RANKS), RANKS).collect(), want)


@pytest.mark.parametrize("doc_id", [1, None])
def test_alike_blocks_stay_apart(spark, doc_id):
    """One id, the same different words, the same length: only the order of the words tells the rows apart."""
    a, b, c = (" " + x * 40 for x in "qzx")
    rows = [(doc_id, a + b + c + b), (doc_id, a + b + c + c), (doc_id, a + b + c + b), (doc_id, c + b + a + b)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    same_rows(bpe.decode(bpe.encode(docs, RANKS), RANKS).collect(), docs.collect())


def test_kept_columns_of_any_type(spark):
    docs = spark.sql("select array(1, 2) as k, date'2024-01-01' as d, cast(null as string) as s, 'two words, unwordlikeness' as text")
    got = bpe.encode(docs, RANKS, keep=("k", "d", "s")).first()
    assert (list(got.k), str(got.d), got.s, list(got.token_ids)) == ([1, 2], "2024-01-01", None, ORACLE.encode_ordinary("two words, unwordlikeness"))


def test_counts_equal_the_ids(spark, odd_docs):
    got = sorted((repr(r.doc_id), r.n_tokens) for r in bpe.count_tokens(odd_docs, RANKS).collect())
    assert got == sorted((repr(r.doc_id), len(ORACLE.encode_ordinary(r.text or ""))) for r in odd_docs.collect())


def test_decoding_of_nulls_and_unknown_ids(spark):
    some = spark.createDataFrame([(1, [15496, 995]), (2, None), (3, []), (4, [0])], "doc_id long, token_ids array<int>")
    want = {1: b"Hello world", 2: None, 3: b"", 4: b"!"}
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(some, RANKS).collect()} == want | {3: b""}
    for bad in ([len(RANKS)], [None], [0, -1]):
        with pytest.raises(Exception, match="an id has no token"):
            bpe.decode(spark.createDataFrame([(1, bad)], some.schema), RANKS).collect()


def test_empty_table(spark, no_docs):
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).collect() == []


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = ORACLE.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
