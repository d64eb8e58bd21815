import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, ids string, hashes int, sequence_id string, kept string, score string, base string, media string, m double"
CLASH = ("l", "i", 1, "s", "k", "c", "b", "p", 0.5)


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "re", "ti", "lo", "me", "su", "ka"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, repeats, ties; (doc_id, text, lang, source, n_chars, clashing names)."""
    base = prose(1)
    texts = [
        (1, base), (2, base), (3, base + " one more"), (4, None), (5, ""), (6, " \t\n "), (7, "a"), (7, "a"), (None, base), (None, None), (8, prose(2, 9000)), (9, "x" * 60_000), (10, "9" * 20_000), (11, "\x00 ▁ \U0001f600 ﬁ\n<|endoftext|>"),
        (12, "Mail ab.c@d-e.com or 10.1.2.3, card 4111 1111 1111 1111, +1 (555) 123-4567.\ntoken = \"" + "0f" * 20 + '"'), (13, "Licensed under the Apache License, Version 2.0.\n" + prose(3)), (14, prose(4).replace(" ", "%%% ")), (15, prose(5, 400)),
    ]
    return [(k, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None if t is None else len(t), *CLASH) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pytest_configure(config):
    config.prose = prose
