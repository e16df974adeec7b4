"""Queries with SQL give DuckDB's rows; the pipeline's stages hold on the smallest tables and on odd ones."""

import hashlib

import pytest

import corpus_pipeline
from matchloom.llm import bpe, decontam, quality, queries, simhash
from matchloom.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()), key=repr)


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        kept.append(corpus_pipeline.cut(out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    field = quality.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in quality.judge(docs, field).where("quality_rules.kept").collect()}
    text = {r.doc_id: r.text for r in kept[1].collect()}
    prints = {i: simhash.fingerprint(t) for i, t in text.items()}
    near = [(a, b) for a in ids[2] for b in ids[2] if a < b and ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 2]
    assert not near
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before, after = (decontam.scan(d, bench).where("n_hit > 0").count() for d in (kept[2], kept[3]))
    assert after == 0 or after < before
    ranks = bpe.public_ranks()
    merge = bpe.encoding(ranks).encode_ordinary
    clean = {r.doc_id: r.text for r in kept[4].collect()}
    assert {r.doc_id: r.token_ids for r in kept[5].collect()} == {i: [x for p in bpe.pretokens(t) for x in merge(p)] for i, t in clean.items()}


def test_run_on_odd_and_empty_documents(spark, odd_docs, no_docs):
    """The whole pipeline over nulls, long and repeated texts and extra columns of clashing names, and over no rows."""
    for docs in (odd_docs, no_docs):
        root = shared_dir(spark)
        docs.write.parquet(f"{root}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
        got = corpus_pipeline.run(spark, root).collect()
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        # what is kept has 50 words or more and, without secrets or benchmark passages in it, decodes to its own text
        want = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts if t}
        assert {(r.doc_id, r.decoded_sha256) for r in got} <= want and len(got) == len({(r.doc_id, r.decoded_sha256) for r in got})
        assert all(r.n_tokens == len(r.token_ids) for r in got) and (len(got) > 5) == (docs is odd_docs)


def test_near_dedup_keeps_one_of_each_group(spark, odd_docs):
    got = corpus_pipeline.near_dedup(spark, odd_docs, SF)
    ids = [r.doc_id for r in got.collect()]
    assert {104, 101, 102} & set(ids) == set() and {103, 100} <= set(ids) and ids.count(105) == 1 and None in ids
    assert got.columns == odd_docs.columns
