"""Verdicts by the digest array, by the join, and by a plain loop over all entries."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import url_filter
from matchloom.llm.common import shared_dir

PAGES = "page_id long, url string"


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def brute(url, entries):
    host, path = parts(url)
    fits = [(r, -len(h) - len(p), -len(h), v != "block", h, p, v) for h, p, v, r in entries if h and ("." + host).endswith("." + h) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and (best[4], best[5], best[6], best[0])


def planted(n=400):
    rng = random.Random(9)
    hosts = ["net", "a.net", "b.a.net", "x.b.a.net", "org", "NET", "xnet", "é.org", "a.net:80", ".net", "a..net"]
    tails = ["", "/", "/en/", "/en/1?x=/de/", "/de/#/en/", "?q", "#f", "/ü/ö", "/en", "\n/en/"]
    urls = [rng.choice(["http://", "https://", "//", "", "u://v://"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(n)]
    return urls + [None, "", "://", "http://" + "a." * 200 + "net/" + "e" * 20_000, urls[0], urls[0]]


ENTRIES = [("net", "/", "block", 1), ("a.net", "/en/", "allow", 1), ("b.a.net", "", "block", 1), ("org", "/ü", "allow", 0), ("net", "/en", "allow", 0), ("a.net", "/", "allow", 2), ("a.net", "/", "block", 2), ("org", "", "allow", 1), ("org", "", "block", 0)]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_verdicts_equal_brute_force(spark, most_bytes):
    urls = planted()
    df = spark.createDataFrame(list(enumerate(urls)), PAGES).select("*", F.lit("x").alias("hit"), F.lit(1).alias("host"))
    entries = spark.createDataFrame([*ENTRIES, (None, "/", "block", 0), ("", "/", "block", 0), ("net", "en", "block", 0), ENTRIES[0]], url_filter.ENTRY)
    got = url_filter.judge(df, entries, most_bytes=most_bytes)
    assert got.columns == ["page_id", "url", "hit", "host", "hit_host", "hit_path", "hit_"]
    rows = {r.page_id: (r.hit_host, r.hit_path, r["hit_"] and tuple(r["hit_"])) for r in got.collect()}
    assert rows == {i: brute(u, ENTRIES) for i, u in enumerate(urls)} and got.count() == len(urls)


def test_empty_list_and_no_urls(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], PAGES)
    none = spark.createDataFrame([], url_filter.ENTRY)
    assert url_filter.judge(df, none).first().hit is None
    assert url_filter.judge(df.limit(0), url_filter.base_rules(spark)).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(tmp_path):
    path = str(tmp_path / "a.bin")
    rows = [(5, "a.net/", 0, 1), (5, "b.net/", 1, 0), (5, "c.net", 2, 1), (-1, "é.org/", 0, 0)]
    url_filter.DigestArray.write(path, iter(rows), len(rows))
    array = url_filter.DigestArray(path)
    asked = [b"c.net", b"x", "é.org/".encode(), b"a.net/", b"b.net/", b"b.net"]
    assert array.probe(asked, np.array([5, 5, (1 << 64) - 1, 5, 5, 5], np.uint64)).tolist() == [2, -1, 3, 0, 1, -1]


def test_keys_are_those_of_spark(spark):
    text = "blog.example.net/ü/"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h % (1 << 64) == url_filter.digest_of(text.encode())


def test_query_equals_brute_force(spark):
    urls = [*planted(), "http://blog.cheap-pills.example.org/", "http://cheappills.org/x", "http://my.casino.example.net/en/", "http://adult.example.com/fr/"]
    root = shared_dir(spark)
    spark.createDataFrame(list(enumerate(urls)), PAGES).select("*", F.lit(None).cast("string").alias("html")).write.parquet(f"{root}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.op11_url_filter(spark, root).collect()}
    for i, u in enumerate(urls):
        host, path, hit = brute(u, [(*r, 0) for r in url_filter.RULES])
        marked = set(re.split(r"[.-]", host)) & set(url_filter.HOST_WORDS)
        assert got[i] == (host, path, hit and hit[0] + hit[1], hit[2] if hit else "block" if marked else "allow")
    assert len(got) == len(urls)
