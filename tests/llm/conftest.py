import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "mañana", "Straße", "x1", "don't", "naïve", "über"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t)) for i, t in enumerate(prose)]
    rows += [(100, None, None, None, None), (None, "lost row with words", "en", "s0", 3), (101, "", "en", None, 0), (102, "   \n\t ", None, "s1", 6)]
    rows += [(103, "same text twice", "en", "s0", 15), (104, "same text twice", "en", "s0", 15), (105, "row", "en", "s0", 3), (105, "row", "en", "s0", 3)]
    rows += [(106, "long " * 30_000 + "aKIA " + "z" * 50_000, "en", "s0", 1), (107, "\U0001f642 emoji 中文 text\r\nline end", "de", "s1", 20)]
    df = spark.createDataFrame(rows, DOCS)
    extra = ["quality_rules", "spans", "h", "blob", "word", "fp", "label", "toxic"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
