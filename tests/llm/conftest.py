import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, language: str = "en") -> str:
    parts = {"en": ["th", "ing", "er", "on", "the", "wh", "ly"], "fr": ["eau", "ment", "é", "oi", "que", "la"], "de": ["sch", "ung", "ä", "keit", "der", "pf"]}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, odd texts, ties and nulls."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 120), rng.choice(["en", "fr", "de"])) for _ in range(40)]
    passage = prose(rng, 45)
    texts += [texts[0], texts[0].replace(" ", "\t\n", 3), texts[1], None, "", None, " \t ", "x", "é", "!!!", "A B c"]
    for k in range(6):
        words = texts[2].split() * 3
        words[k * 7 % len(words)] = f"new{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 9)} {passage} {prose(rng, 12)}" for _ in range(5)]
    texts += ["be " * 150, "ab" * 400, prose(rng, 6000)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "Ä"]), len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here", None, None, 0), (None, texts[0], "en", "a", 1)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those that operators make themselves."""
    from pyspark.sql import functions as F

    names = ["id", "k", "h", "n", "size", "row", "bucket", "slot", "shard", "sid", "key", "score", "lo", "block", "kept", "at", "cell"]
    return docs.select("*", *[F.lit(f"{c}!").alias(c) for c in names])
