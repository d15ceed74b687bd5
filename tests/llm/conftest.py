"""Small documents with everything that tables may hold."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, row long, fp long, size long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def rows_of(texts: list) -> list[tuple]:
    """doc_id, text and, for the rest, columns whose names operators use themselves."""
    return [(i, t, "en", f"s{i % 3}", len(t or ""), "k", "i", 7, 8, 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    base, other = words(rng, 120), words(rng, 80)
    shared = words(rng, 60)
    texts = [base, other, f"{words(rng, 50)} {shared} {words(rng, 30)}", f"{shared} {words(rng, 40)}", base, None, "", "   \n\t ", "one", "x " * 90, "x " * 40, "é ñ ü " * 20]
    texts += ["a b c\nd e f\ng h i\nj k l", "a b c\nd e f\ng h i\nm n o", "z\nz\nz\nz\nz", words(rng, 5000)]
    rows = rows_of(texts)
    rows += [rows[0], rows[6]]  # repeated rows
    rows += [(None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, other + " more", "en", "s0", 1, "k", "i", 7, 8, 9)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
