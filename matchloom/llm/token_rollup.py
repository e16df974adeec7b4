"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) becomes signed sums of documents and tokens and is committed to a
store under its id: written to a fresh path, then published by one manifest row. A replayed id changes nothing, a batch
that fails leaves nothing that is read, and a published batch is never written over. Totals are the sum of the published
batches; ``compact`` publishes one batch in place of others.

Tokens are counted by real tokenizers: the byte-level BPE of 50,256 ranks, and words between ASCII white spaces.

Defined results: null source, lang or tokenizer are groups of their own; null counts are 0 tokens; a null or empty text
has 0 tokens; repeated rows count as often as they come; a group that sums to no documents and no tokens is not listed;
an empty batch is a valid commit. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe
from matchloom.llm.common import Store, cut, read_table, replicated, shared_dir, spread, text_or_empty

KEYS = ("source", "lang", "tokenizer")
#: Versions of the two tokenizers.
BPE, WORDS = "byte_bpe_50k", "ascii_words_v1"
_WORD = r"[^\x20\x09-\x0D]+"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes`` (source, lang, tokenizer, op, n_tokens, old_tokens).

    op is insert, delete or revise; delete takes n_tokens away, revise puts n_tokens in place of old_tokens.
    """
    n, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def commit(store: Store, batch_id: str, changes: DataFrame) -> bool:
    """Commit one batch; False, with nothing done, if its id was committed before. Ids are letters, digits, - and _."""
    return store.commit(batch_id, signed(changes))


def totals(store: Store, batches: dict[str, str] | None = None) -> DataFrame:
    """Totals over the given batches of a snapshot, or over all that are committed."""
    summed = store.read(_DELTA, batches).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs <> 0 or n_tokens <> 0")


def compact(store: Store, into: str) -> bool:
    """Put one batch with today's totals in place of all that are published; one snapshot names both, so what is published
    meanwhile stays."""
    seen = store.batches()
    return store.commit(into, totals(store, seen), replaces=seen)


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_WORD), 0)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, blob, and the tokens of both tokenizers beside a guess by bytes of every row of ``docs``."""
    rows = docs.select("doc_id", "source", "lang", text_or_empty().alias("text"))
    guess = F.ceil(F.octet_length("text") / 4).cast("long")
    rows = rows.withColumns({"blob": F.unhex(F.sha2("text", 256)), "words": count_words(F.col("text")), "guess": guess})
    return bpe.count_tokens(rows, bpe.public_ranks(), keep=("doc_id", "source", "lang", "blob", "words", "guess"), name="bpe")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted under both tokenizers, BPE with a guess of a token every four bytes; a revision puts the
    counted tokens in the guess's place; later copies of a text are deleted; the revision is replayed, which changes
    nothing; the batches are compacted."""
    facts = cut(counted(read_table(spark, sf_dir, "documents")))
    firsts = facts.groupBy("blob").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # one text may fill a large part of the table, so its rows are dealt to several tasks
    later = facts.withColumn("part", spread()).join(replicated(firsts, "part"), ["blob", "part"]).where(F.col("doc_id") > F.col("first"))

    def changes(rows: DataFrame, op: str, **counts: tuple[str, str | None]) -> DataFrame:
        each = [F.struct(F.lit(t).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens")) for t, (n, old) in counts.items()]
        return rows.select("source", "lang", F.lit(op).alias("op"), F.inline(F.array(*each)))

    store = Store(spark, shared_dir(spark))
    revision = changes(facts, "revise", **{BPE: ("bpe", "guess")})
    commit(store, "b0-insert", changes(facts, "insert", **{BPE: ("guess", None), WORDS: ("words", None)}))
    commit(store, "b1-revise", revision)
    commit(store, "b2-delete", changes(later, "delete", **{BPE: ("bpe", None), WORDS: ("words", None)}))
    commit(store, "b1-revise", revision)
    compact(store, "b3-compact")
    return totals(store)
