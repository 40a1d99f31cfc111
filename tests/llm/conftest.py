import datetime
import random

import pytest

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from [(doc_id, text)] or longer tuples."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Repeatable invented prose: prose(seed, words)."""

    def make(seed, n, vocabulary=3000):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) if rng.random() < 0.7 else f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Rows that every operator has to bear: nulls, empty and very long texts, repeats, ties."""
    long = prose(99, 20_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (None, "text without an id, but with words enough to count"), (None, None), (4, long), (5, long), (6, "one"),
        (7, "same row"), (7, "same row"), (7, "another text under one id"), (8, "ÄÖÜ é 梦 \U0001F600 ▁   x"), (9, "...,,, !!! 123"), (10, "the " * 300),
    ]


@pytest.fixture(scope="session")
def clashing(docs_of, odd_rows):
    """The odd rows with extra columns whose names operators use for themselves."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(f"mine-{c}") for c in ("score", "rank", "shard", "slot", "key", "n", "id", "digest", "keys", "bucket", "component", "label")}
    return docs_of(odd_rows).withColumns(extra | {"day": F.lit(datetime.date(2020, 1, 2))})
