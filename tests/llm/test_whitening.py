"""Whitening against eigenvectors of the covariance, and in the cases where it has none."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from nearwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id long, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(5)


def whole(v):
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def brute(rows, dim):
    """(ids, x), covariance's eigenvalues and eigenvectors over the different x."""
    use = [(i, whole(v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in use]), axis=0)
    centred = fit - fit.mean(axis=0)
    e, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return use, fit, e[::-1], axes[:, ::-1]


def held(got, rows, dim, components=16):
    use, fit, e, axes = brute(rows, dim)
    k = min(components, dim)
    found = [r for r in got if r["component"] <= k]
    assert Counter((r["id"], r["component"]) for r in found) == Counter((i, c + 1) for i, _ in use for c in range(k))
    sums = [int(s) for s in fit.sum(axis=0)]
    x_of, by_id = dict(use), {}
    for r in found:
        by_id.setdefault(r["id"], {})[r["component"]] = r
    ids = sorted(x_of)
    for i in ids:
        r = by_id[i][1]
        assert r["n"] == len(fit)
        assert r["deviation"] == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(x_of[i], sums, strict=True))
    for c in range(k):
        want = np.array([(x_of[i] - fit.mean(axis=0)) @ axes[:, c] / np.sqrt(e[c]) for i in ids])
        w = np.array([by_id[i][c + 1]["whitened"] for i in ids])
        assert np.allclose(w, want * np.sign(w @ want), rtol=1e-8, atol=1e-8)
        assert by_id[ids[0]][c + 1]["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
        assert by_id[ids[0]][c + 1]["identity_error"] < 1e-9


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 24)) * np.geomspace(5, 0.05, 24) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(500 + i, rows[7][1]) for i in range(200)]  # copies: a third of all rows
    bad = [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [2.0**40] * 24)]
    got = whitening.whiten(frame(spark, rows + bad)).collect()
    held(got, rows, 24)
    assert {r["id"] for r in got} == {i for i, _ in rows}


def test_lengths_apart(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    short, long = [(i, rng.normal(size=3).tolist()) for i in range(40)], [(100 + i, rng.normal(size=20).tolist()) for i in range(60)]
    got = whitening.whiten(frame(spark, short + long)).collect()
    held([r for r in got if r["id"] < 100], short, 3)
    held([r for r in got if r["id"] >= 100], long, 20)


def test_without_spread(spark):
    got = whitening.whiten(frame(spark, [(i, [1.5, 1.5]) for i in range(3)] + [(None, [1.5, 1.5])])).collect()
    assert Counter((r["id"], r["component"]) for r in got) == Counter((i, c) for i in (0, 1, 2, None) for c in (1, 2))
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, 0.0)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert whitening.whiten(frame(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_large_numbers(spark):
    """Sums beyond 64 bits stay exact; deviations beyond them are null."""
    top = 2.0**39
    got = whitening.whiten(frame(spark, [(0, [top, 0.0]), (1, [-top, 0.0]), (2, [top, 1.0])])).collect()
    assert {r["n"] for r in got} == {3} and {r["deviation"] for r in got} == {None}
    assert max(r["identity_error"] for r in got) < 1e-4


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    r = np.linalg.qr((rng.normal(size=(90, 7)) * np.geomspace(1, 1e-6, 7)) @ q, "r")
    norms, axes = whitening.jacobi(r)
    assert np.allclose(norms, np.linalg.svd(r, compute_uv=False), rtol=1e-9)
    assert np.allclose(axes.T @ axes, np.eye(7), atol=1e-13)
