from __future__ import annotations

import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(n))


#: Texts with everything that may be odd: (id, text).
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "Hello World"),
    (5, "hello world"),
    (5, "hello world"),
    (None, "HELLO WORLD"),
    (None, None),
    (6, "É é É 日本語 🙂 \x00 x"),
    (7, words(1, 40)),
    (8, words(1, 40).upper()),
    (9, words(2, 30000)),
    (10, "x" * 20000),
    (11, "word " * 3000),
    (12, "<|endoftext|> a <|startoftext|> b"),
]
COLUMNS = "doc_id long, text string, key string, row int, kept string, ids string, n_tokens int, words string, bench int, quality int, lm int, repeats int, label int, digest string"


@pytest.fixture(scope="session")
def odd(spark):
    """ODD, with more columns whose names the operators use themselves."""
    rows = [(i, t, "k", n, "no", "i", 7, "w", 1, 2, 3, 4, 5, "d") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
