from __future__ import annotations

import random

import pytest

DOCUMENT = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside.
    "score double, queue string, anchor string, bucket int, keys string, label string, kept string"
)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a document table from (doc_id, text[, lang, source]) rows."""

    def build(rows):
        full = [
            (
                r[0],
                r[1],
                r[2] if len(r) > 2 else "en",
                r[3] if len(r) > 3 else "s",
                len(r[1] or ""),
                *([None] * 7),
            )
            for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENT).repartition(3)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded words: prose(n, seed)."""

    def make(n, seed=0):
        rng = random.Random(seed)
        parts = ["an", "be", "ti", "on", "er", "the", "of", "and", "re", "st"]
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
        return " ".join(words)

    return make


@pytest.fixture(scope="session")
def awkward(prose):
    """Nulls, empty and blank texts, repeated rows, a long text, odd characters."""
    long = prose(30_000, 5)
    return [
        (1, prose(80, 1), "en", "a"),
        (2, prose(80, 1), "en", None),
        (2, prose(80, 1), "en", None),
        (3, None, None, "a"),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", "a"),
        (6, long, "en", "b"),
        (7, "Élan über ñandú \U0001f600 x\x00y <|endoftext|>  z \n\n q", "fr", "b"),
        (None, prose(80, 1), "en", "a"),
        (None, None, None, None),
        (8, "x" * 3000, "en", "b"),
        (9, "12345 67890 !!!", None, "b"),
    ]
