import re

import pytest

from matchloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(width, len(v))
            for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == g:
                        hit.update(range(k, k + n))
                        found.add(item)
        out[i] = (len(w), len(hit), {x for x in found if x is not None})
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "nameless"), (5, "short item"), (6, "ÉTÉ été")]
DOCS = [
    (1, "x ONE, two three four five six seven eight nine ten! eleven y"), (2, "two three four five"), (3, "a short-item and short item short item"), (4, None), (5, ""),
    (6, "nameless"), (7, "ÉTÉ été"), (8, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten eleven"),
]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_hits_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs.union(docs.where("doc_id in (1, 4, 6)"))  # repeated rows
    got = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in decontam.scan(docs, bench).collect())
    want = brute(DOCS, ITEMS)
    assert got == sorted((i, *want[i][:2], sorted(want[i][2])) for i in [*want, 1, 4, 6])


def test_empty_benchmark_and_repeats(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.scan(odd_docs, none).collect()
    assert all(r.n_hit == 0 for r in got) and sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in odd_docs.collect())
    assert decontam.scan(no_docs, none).count() == 0
    assert decontam.remove(odd_docs, none).count() == odd_docs.count()


def test_removal(spark):
    filler = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{filler} Short Item, tail", 9), (2, "short item", 9), (3, filler, 9), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.remove(docs, bench).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == f"{filler} tail" and got[1].n_chars == len(got[1].text) and got[3].n_chars == 9
