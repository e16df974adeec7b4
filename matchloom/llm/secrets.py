"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text, its blob. The ledger is a store of batches whose
rows hold a blob, the rule versions it was scanned with and what they found, so ledger and findings are published
together. An increment scans only the pairs of blob and rule version that no published batch has, one text for each
blob however many paths hold it. Findings are then read back from the store for all paths, scanned now or before.

Defined results: a null text is the empty blob. Repeated rows are paths of one blob and all get its findings; a null
doc_id is a path like any other. Spans are in code points, end exclusive. A rule's new version replaces the spans of the
old one. Extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import Store, fresh_name, read_table, replicated, shared_dir, spread, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are leftmost and non-overlapping; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed. The hex and access patterns take whole runs, so a length in the pattern
#: equals a test of the run afterwards; they fail fast on the many short runs of ordinary words.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{24})"),
    Rule("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9+/_.=-]{24,}"),
)
_SPANS = "array<struct<start:int,stop:int,rank:int,kind:string,rule:string>>"
LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Items walked together: a walk appends to short arrays only, so its time grows with the items and not with their square.
_CHUNK = 256


def _walked(items: Column, total: Callable, join: Callable, inner: Callable) -> Column:
    """The arrays that ``inner(chunk, at)`` makes of each chunk of ``items``, joined; ``at`` is what ``join`` makes of the
    ``total`` of all chunks before, from 0."""

    def walk(kept):
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(kept) - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: F.slice(kept, i + 1, F.lit(_CHUNK)))
        before = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.array_append(a, join(F.element_at(a, -1), total(c))))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), inner))

    # ``items`` is the one value of an array of one, so that it is worked out once and not for every chunk
    return F.flatten(F.transform(F.array(items), walk))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text. The pieces between matches give their places, as functions return only strings."""
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else hits
    parts = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), kept, lambda x, k: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(k).alias("val")))
    parts = F.filter(parts, lambda x: x["hit"].isNotNull())
    empty = F.array().cast(_SPANS)

    def step(a, x):
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["hit"]).alias("stop"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["val"] >= rule.least, F.array_append(a["out"], span)).otherwise(a["out"]).cast(_SPANS).alias("out"))

    def length(chunk):
        return F.aggregate(chunk, F.lit(0), lambda a, x: a + x["gap"] + x["hit"])

    walked = _walked(parts, length, lambda a, n: a + n, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step)["out"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


def paths_of(docs: DataFrame) -> DataFrame:
    """doc_id and blob of every row of ``docs``."""
    return docs.select("doc_id", blob_of(text_or_empty()).alias("blob"))


def unseen(docs: DataFrame, rules: tuple[Rule, ...], store: Store) -> DataFrame:
    """blob, one path that holds it, and the keys of the rules it was never scanned with; blobs without any are left out."""
    # one path stands for a blob; the struct keeps null ids comparable
    blobs = paths_of(docs).groupBy("blob").agg(F.min(F.struct("doc_id"))["doc_id"].alias("path"))
    every = F.array(*(F.lit(r.key) for r in rules))
    if not store.batches():
        return blobs.withColumn("rules", every)
    # a blob has one row a batch that scanned it, at most as many as there are rule versions
    seen = store.read(LEDGER).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.where(F.size("rules") > 0).select("blob", "path", "rules")


def scan(docs: DataFrame, store: Store, batch: str, rules: tuple[Rule, ...] = RULES) -> bool:
    """Scan the unseen pairs of ``docs`` (doc_id, text) and publish them as ``batch``; False if that id is published."""
    if batch in store.batches():
        return False
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("blob", blob_of(F.col("text")))
    todo = unseen(docs, rules, store).withColumnRenamed("blob", "b")
    texts = rows.join(todo, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("path")))
    found = [F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r, i)).otherwise(F.array().cast(_SPANS)) for i, r in enumerate(rules)]
    # no filter on empty results here: Spark would push it down and scan every text twice
    return store.commit(batch, texts.select("blob", "rules", F.array_sort(F.concat(*found)).alias("spans")).dropDuplicates(["blob"]))


def _distinct(ordered: Column) -> Column:
    """The different items of an ordered array, each compared with the one before it only."""
    return F.filter(ordered, lambda x, i: (i == 0) | (x != F.element_at(ordered, F.greatest(i, F.lit(1)))))


def findings(store: Store, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans of every scanned blob that has any under the present versions of ``rules``."""
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    now = F.filter("spans", lambda s: s["rule"].isin(*(r.key for r in rules)))
    # the order of kinds is that of these rules, whatever it was when a blob was scanned
    now = F.transform(now, lambda s: s.withField("rank", rank[s["rule"]]))
    some = store.read(LEDGER).select("blob", now.alias("spans")).where(F.size("spans") > 0)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))  # of one text, from at most as many batches as rule versions
    return some.groupBy("blob").agg(spans.alias("spans")).select("blob", _distinct(F.col("spans")).alias("spans"))


def located(rows: DataFrame, found: DataFrame, blob: Column, name: str) -> DataFrame:
    """``rows`` with the spans of their blob as ``name``, null without any. A blob that very many rows hold is dealt to several tasks."""
    salt, key, part = fresh_name(rows, "_salt"), fresh_name(rows, "_blob"), fresh_name(rows, "_part")
    right = replicated(found.select(F.col("blob").alias(key), F.col("spans").alias(name)), part)
    left = rows.withColumn(salt, spread())
    return left.join(right, (blob == F.col(key)) & (F.col(salt) == F.col(part)), "left").drop(salt, key, part)


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Characters of a text cut out together: a piece is then looked up in its block and not from the text's start.
_BLOCK = 1 << 16


def _without(text: Column, spans: Column) -> Column:
    """``text`` with each span (in order) replaced by ``[kind]``; a span that starts within an earlier one only lengthens its hole."""
    held = F.array().cast("array<struct<start:int,kind:string,at:int>>")

    def step(a, s):
        hole = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), a["at"].alias("at"))
        out = F.when(s["start"] >= a["at"], F.array_append(a["out"], hole)).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.cast("array<struct<start:int,kind:string,at:int>>").alias("out"))

    def last(chunk):
        return F.aggregate(chunk, F.lit(0), lambda a, s: F.greatest(a, s["stop"]))

    holes = _walked(spans, last, lambda a, b: F.greatest(a, b), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), held.alias("out")), step)["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(_BLOCK)), lambda i: F.substring(text, i + 1, F.lit(_BLOCK)))

    def piece(x, kept):
        block, offset = F.floor(x["at"] / _BLOCK).cast("int"), x["at"] % _BLOCK
        inside = F.substring(F.element_at(kept, block + 1), offset + 1, x["start"] - x["at"])
        gap = F.when(offset + x["start"] - x["at"] <= _BLOCK, inside).otherwise(F.substring(text, x["at"] + 1, x["start"] - x["at"]))
        return F.concat(gap, F.lit("["), x["kind"], F.lit("]"))

    # the blocks are one value of an array of one, so that they are cut once and not for every hole
    pieces = F.flatten(F.transform(F.array(blocks), lambda kept: F.transform(holes, lambda x: piece(x, kept))))
    return F.concat(F.array_join(pieces, ""), F.substring(text, last(spans) + 1, F.length(text)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, store: Store | None = None, batch: str = "redaction") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]``; of overlapping spans the first names the hole."""
    store = store or Store(docs.sparkSession, shared_dir(docs.sparkSession))
    scan(docs, store, batch, rules)
    spans = fresh_name(docs, "_spans")
    joined = located(docs, findings(store, rules), blob_of(text_or_empty()), spans)

    clean = F.when(F.col(spans).isNotNull(), _without(F.coalesce("text", F.lit("")), F.col(spans)))
    changed = {"text": F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments over one ledger: the documents of every source but the first in order arrive and are scanned with
    the base rules; then the whole table is scanned with all rules, which leaves only the pairs not seen before."""
    docs = read_table(spark, sf_dir, "documents")
    store = Store(spark, shared_dir(spark))
    first = docs.agg(F.min("source").alias("first_source"))  # one row
    earlier = docs.join(F.broadcast(first), F.coalesce(F.col("source") != F.col("first_source"), F.lit(True))).drop("first_source")
    scan(earlier, store, "increment-1", tuple(r for r in RULES if r.base))
    scan(docs, store, "increment-2")
    rows = located(paths_of(docs), findings(store), F.col("blob"), "spans").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    kinds = [r.kind for r in RULES if r.base]

    def of_kind(k: str):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *counts, F.sha2(render(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
