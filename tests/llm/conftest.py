import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as a table of documents with columns of clashing names."""

    def make(rows):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, class int")

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words; the seed tells them apart."""

    def make(seed, n_words, vocabulary=300):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
        return " ".join(r.choice(words) for _ in range(n_words))

    return make
