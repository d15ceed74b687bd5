"""Nearest vectors against all products in double."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nearwise.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def brute(rows, k):
    use = [r[:2] for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = Counter()
    for at, (q, a) in enumerate(use):
        if q % 20 == 0:
            scored = sorted((-sum_in_order(a, b), i) for n, (i, b) in enumerate(use) if n != at and len(a) == len(b))
            out.update((q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1))
    return out


def test_extreme_scales(spark):
    """Large components overflow, small ones vanish, and both stand beside ordinary ones: no neighbour is missed."""
    rng = np.random.default_rng(6)
    for scales in ((1e160,), (1e-170,), (1e-310,), (1e160, 1.0, 1e-160, 1e-310, 1e300)):
        rows = [(i, [float(c) * scales[i % len(scales)] for c in v]) for i, v in enumerate(rng.normal(size=(120, 8)))]
        got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
        order = lambda s: (s == s, -s if s == s else 0.0)
        want = Counter()
        for q, a in rows[::20]:
            scored = sorted((*order(sum_in_order(a, b)), i) for i, b in rows if i != q)
            want.update((q, n, i) for n, (_, _, i) in enumerate(scored[:20], 1))
        assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in got) == want


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def test_nearest(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    base[100:140] = base[60]  # ties
    base[150:170] *= 1e-20
    base[170:190] *= 1e15
    rows = [(i, [float(x) for x in v], 1, 2, "x") for i, v in enumerate(base)]
    rows += [(400, None, 1, 2, "x"), (420, [0.0] * 16, 1, 2, "x"), (440, [float("nan")] * 16, 1, 2, "x"), (460, [None] * 16, 1, 2, "x"), (480, [float("inf")] + [1.0] * 15, 1, 2, "x")]
    rows += [(500, [], 1, 2, "x"), (520, [1.0, 2.0], 1, 2, "x"), (521, [2.0, 2.0], 1, 2, "x"), (None, [1.0] * 16, 1, 2, "x"), rows[20], (40, [5.0] * 16, 1, 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"block": 40, "query_block": 5}):
        got = nearest(df, F.col("vec_id") % 20 == 0, k=20, **options).collect()
        assert Counter(map(tuple, got)) == brute(rows, 20)
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id in (520, 521)"), F.col("vec_id") % 20 == 0).count() == 1
