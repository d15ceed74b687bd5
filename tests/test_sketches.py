"""Sketches against exact figures, at every level."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from nearwise.operators.sketches import cell_estimates, cell_sketches

SCHEMA = "x double, y double, v double, level string"


def test_bounds_hold_at_every_level(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(-80, 80), rng.uniform(-80, 80), round(rng.choice((-1, 1, 1)) * rng.lognormvariate(2, 2), 2), "") for _ in range(6000)]
    rows += [(1.0, 1.0, 0.0, "")] * 500 + [(-70.0, 3.0, None, ""), (3.0, 70.0, float("nan"), ""), (3.0, 70.0, float("inf"), ""), (None, 1.0, 5.0, ""), (float("nan"), 1.0, 5.0, ""), (500.0, 500.0, None, "")]
    shares, error = (0.0, 0.25, 0.5, 0.99, 1.0), 0.02
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["level"], r["cx"], r["cy"]): r for r in cell_estimates(cell_sketches(df, 20, 4, value="v", error=error), shares, error=error).collect()}
    cells = defaultdict(list)
    for x, y, v, _ in rows:
        if x is not None and math.isfinite(x):
            for level in range(4):
                cells[level, math.floor(math.floor(x / 20) / 2**level), math.floor(math.floor(y / 20) / 2**level)].append(v)
    assert set(got) == set(cells)
    for key, values in cells.items():
        known = sorted(v for v in values if v is not None and math.isfinite(v))
        assert got[key]["n"] == len(values)
        assert abs(got[key]["distinct"] - len(set(known))) <= max(1, 0.05 * len(set(known)))  # three standard errors of 2^12 registers
        want = [known[max(1, math.ceil(s * len(known))) - 1] if known else None for s in shares]
        for one, exact in zip(got[key]["quantiles"], want, strict=True):
            assert (one is None) == (exact is None)
            assert exact is None or abs(one - exact) <= error * abs(exact) * (1 + 1e-9)


def test_empty_and_wrong(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cell_estimates(cell_sketches(none, 1, 2, value="v"), [0.5]).count() == 0
    for bad in ({"size": 0, "levels": 1}, {"size": 1, "levels": 0}):
        with pytest.raises(ValueError):
            cell_sketches(none, value="v", **bad)
    with pytest.raises(ValueError):
        cell_estimates((none, none), [1.5])
