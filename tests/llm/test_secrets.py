import hashlib
import time
import re

from pyspark.sql import functions as F

from matchloom.llm import secrets
from matchloom.llm.common import Store, shared_dir

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    "token = \"0123456789abcdef0123456789abcdef\" end", f"é {KEY} and password=short then PASSWD: longenough1", "secret=token: abcdefghij", "Api_Key='k.k.k.k.k.k' apikey:zzzzzzzz",
    "f" * 31 + " " + "f" * 32 + "g" + "a" * 40, f"{KEY}x AKIA123 {'AKIA' * 6}", "\U0001f642 token=abcdefgh\n" * 5, None, "", "ghp_" + "a1B2" * 9,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "token=" * 5 + "token==========",
]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def base(spans):
    return [(s.kind, s.start, s.stop) for s in spans if s.kind in ("assign", "access", "hex")]


def scanned(spark, docs, rules=secrets.RULES):
    """Spans of every row of ``docs`` after one increment."""
    store = Store(spark, shared_dir(spark))
    assert secrets.scan(docs, store, "one", rules)
    return secrets.located(secrets.paths_of(docs), secrets.findings(store, rules), F.col("blob"), "spans")


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {r.doc_id: r.spans or [] for r in scanned(spark, docs).collect()}
    assert {i: base(s) for i, s in rows.items()} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert [s.kind for s in rows[9]] == ["vendor"] and [s.kind for s in rows[10]] == ["pem"]


def test_long_key_bodies_and_headers(spark):
    body = "Proc-Type: 4,ENCRYPTED\n" + "A" * 30_000
    text = f"x -----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY----- y"
    got = scanned(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.stop) for s in got.spans if s.kind == "pem"] == [("pem", 2, len(text) - 2)]


def test_ledger_scans_only_unseen_pairs(spark):
    store = Store(spark, shared_dir(spark))

    def pairs(batch):
        path = store.batches()[batch]
        return {(bytes(r.blob), k) for r in spark.read.parquet(f"{store.root}/{path}").collect() for k in r.rules}

    def kinds(docs, rules=secrets.RULES):
        rows = secrets.located(secrets.paths_of(docs), secrets.findings(store, rules), F.col("blob"), "spans").collect()
        return {r.doc_id: {s.rule for s in r.spans or ()} for r in rows}

    first = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[0])], "doc_id long, text string")
    assert secrets.scan(first, store, "a") and len(pairs("a")) == len(secrets.RULES)
    both = first.union(spark.createDataFrame([(3, TEXTS[1]), (4, TEXTS[0])], first.schema))
    assert secrets.scan(both, store, "b") and len(pairs("b")) == len(secrets.RULES) and not pairs("a") & pairs("b")
    # the known blob keeps its findings for its old paths and its new one
    assert kinds(both) == {1: {"assign@1", "hex@1"}, 2: {"assign@1", "hex@1"}, 4: {"assign@1", "hex@1"}, 3: {"assign@1", "access@1"}}
    assert not secrets.scan(both, store, "b") and secrets.scan(both, store, "c") and not pairs("c")
    newer = (secrets.Rule("assign", r"end()", version=2, base=True), *secrets.RULES[1:])
    assert secrets.scan(both, store, "d", newer) and {k for _, k in pairs("d")} == {"assign@2"} and len(pairs("d")) == 2
    assert kinds(both, newer) == {1: {"assign@2", "hex@1"}, 2: {"assign@2", "hex@1"}, 4: {"assign@2", "hex@1"}, 3: {"access@1"}}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], 5), (2, "clean", 5), (None, TEXTS[1], 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert got[1].text == "[assign]\" end" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[3].text is None
    assert got[None].text == "é [access] and password=short then [assign]"


def test_many_findings_take_linear_time(spark):
    """100,000 findings in one text, some of which overlap, scanned and redacted as by a plain loop."""
    text = "é" + " ".join(f"password=abcdefgh{i:06d}" if i % 3 else f"AKIA{i:016d}" for i in range(100_000)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = scanned(spark, docs).first()
    assert [(s.kind, s.start, s.stop) for s in row.spans if s.kind in ("assign", "access", "hex")] == brute(text)
    clean = secrets.redact(docs).first().text
    assert time.monotonic() - began < 120
    out, at = [], 0
    for s in row.spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.stop)
    assert clean == "".join([*out, text[at:]])


def test_holes_over_blocks_and_chunks(spark, monkeypatch):
    """Small blocks and chunks cut through gaps and holes; overlapping spans make one hole."""
    monkeypatch.setattr(secrets, "_BLOCK", 7)
    monkeypatch.setattr(secrets, "_CHUNK", 2)
    text = "0123456789ébcdefghijklmnopqrstuvwxyz"
    spans = [(2, 4, "a"), (4, 5, "b"), (9, 15, "c"), (11, 20, "d"), (19, 21, "e"), (34, 36, "f")]
    rows = [(text, [(a, b, 0, k, k) for a, b, k in spans[:n]]) for n in range(7)]
    df = spark.createDataFrame(rows, f"text string, spans {secrets._SPANS}")
    got = [r.c for r in df.select(secrets._without(F.col("text"), F.col("spans")).alias("c")).collect()]
    for (_, use), c in zip(rows, got):
        out, at = "", 0
        for a, b, _, k, _ in use:
            out, at = out + (f"{text[at:a]}[{k}]" if a >= at else ""), max(at, b)
        assert c == out + text[at:]


def test_odd_rows(spark, odd_docs, no_docs):
    assert scanned(spark, odd_docs).count() == odd_docs.count()
    assert secrets.redact(odd_docs).columns == odd_docs.columns and secrets.redact(odd_docs).count() == odd_docs.count()
    assert scanned(spark, no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in secrets.op2_secret_scan(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r.text)
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
