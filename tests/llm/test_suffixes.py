"""Repeated strings of bytes against a look at every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearwise.llm import suffixes as s

from .conftest import SCHEMA, rows_of


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = Counter()
    for id_, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[(id_, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("v", s.COVERS)
def test_covers_hold_every_distance(v):
    assert {(a - b) % v for a in s.COVERS[v] for b in s.COVERS[v]} == set(range(v))


@pytest.mark.parametrize(("window", "passes"), [(200, 3), (47, 1), (12, 4)])
def test_against_every_window(spark, odd, odd_rows, window, passes):
    got = s.remove_repeats(odd, window=window, passes=passes).collect()
    assert Counter(map(tuple, got)) == brute(odd_rows, window)


def test_shifts_copies_and_bytes(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefgh é☃", k=n))
    shared = letters(260)
    texts = [letters(i) + shared[i % 7 :] + letters(300 - i) for i in range(0, 300, 11)]  # all shifts, ends inside characters
    texts += [shared[:150] + letters(80), shared[:199], letters(500) * 2, "a" * 900, "ab" * 400, letters(40_000)]
    texts += [texts[-1][20_000:20_300] + "z", *[texts[3]] * 60]
    rows = rows_of(texts)
    rows += [rows[-1]] * 40  # a third of all rows are one text, and many of those one row
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = s.remove_repeats(df, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows, 200)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_only_copies_repeat(spark):
    """What a copied text shares with another goes there too, though only one copy is compared."""
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh", k=700))
    rows = rows_of([text, text, text, "start " + text[100:420] + " end", "other " * 10])
    rows += [rows[0]]
    assert Counter(map(tuple, s.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 200)


def test_empty(none):
    assert s.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        s.remove_repeats(none, window=10)


def test_names_piece_by_piece():
    text = np.frombuffer(bytes(random.Random(1).choices(range(256), k=5000)), np.uint8)
    at = np.arange(0, 4800)
    assert (s.names(text, at, 200) == s.names(text, at, 200, piece=333)).all()
    assert len(np.unique(s.names(text, at, 200))) == len(at)
