"""The pipeline's near dedup against brute-force Jaccard."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from nearwise.llm import nearcopies
from tests.llm.conftest import words

SCHEMA = "doc_id long, text string"


def shingles(text: str | None) -> set[tuple]:
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_force(rows: list[tuple]) -> set:
    """The smallest id of each group."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    groups: dict = {}
    for (id_, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(id_)
    return {min((i for i in g if i is not None), default=None) for g in groups.values()}


def edited_rows() -> list[tuple]:
    rng, texts = random.Random(3), []
    line = words(rng, 12)
    for _ in range(40):
        base = words(rng, rng.randrange(4, 200)).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(copy + line.split() * (rng.random() < 0.2)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (None, texts[0]), rows[0]]


def test_stage_is_brute_force_jaccard(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    want = brute_force(rows)
    assert len(kept) == len(want) and set(kept) == want
    assert corpus_pipeline.dedup_near(spark, docs.limit(0), "").count() == 0


def test_stage_goes_through_the_byte_position_index(spark, monkeypatch):
    """What the index links and the sets confirm is not looked for again."""
    rng = random.Random(8)
    base = words(rng, 3000).split()
    texts = [" ".join(base[:-i] if i else base) for i in range(4)] + [words(rng, 60) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    pairs, asked, links, verified = [], [], nearcopies.indexed, nearcopies._verified

    def index(distinct):
        found = links(distinct)
        pairs.extend((r["a"], r["b"]) for r in found.collect())
        return found

    def verify(found, *rest):
        asked.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(nearcopies, "indexed", index)
    monkeypatch.setattr(nearcopies, "_verified", verify)
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == brute_force(list(enumerate(texts))) == {0, *range(4, 10)}
    names = {nearcopies.name_of(nearcopies.shingle_set(t.encode())) for t in texts[:4]}
    assert len(pairs) == 3 and {x for p in pairs for x in p} == names and asked == [3, 0, 0]


@pytest.mark.parametrize("tile", [2, 5])
def test_tiles_and_often(spark, monkeypatch, tile):
    monkeypatch.setattr(nearcopies, "OFTEN", 2)
    rows = edited_rows()[:120]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(nearcopies.links, "__defaults__", (5, tile))
    assert {r["doc_id"] for r in nearcopies.keep_one(docs).collect()} == brute_force(rows)


def test_lists_whatever_the_batches():
    rng = random.Random(4)
    rows = sorted({(rng.randrange(30), rng.choice([-1, -1, 0, 1]) if t % 3 else -1, rng.randrange(50)) for t in range(120)})
    lists: dict = {}
    for token, chunk, name in rows:
        lists.setdefault((token, chunk), []).append(name)
    want = [(t, c, x, names[0]) for (t, c), names in lists.items() for x in names if len(names) > 1 or c >= 0]
    for most in (1, 2, 3, 7, 200):
        batches, at = [], 0
        while at < len(rows):
            part = rows[at : at + rng.randrange(1, most + 1)]
            at += len(part)
            columns = [[r[0] for r in part], [r[1] for r in part], [r[2] for r in part], [1] * len(part), [0] * len(part)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["token", "chunk", "set", "n", "place"]))
        got = [tuple(r[c] for c in ("token", "chunk", "set", "hub")) for b in nearcopies._lists(iter(batches)) for r in b.to_pylist()]
        assert got == want
    assert list(nearcopies._lists(iter([]))) == []


def test_sketches_never_differ_in_more_than_the_sets():
    rng = random.Random(6)
    for n in (3, 90, 700, 5000):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: int(n * rng.uniform(0.6, 1))]) | {rng.getrandbits(64) for _ in range(rng.randrange(1 + n // 3))}
        x, y = (nearcopies.sketch_of(np.array(sorted(s), np.uint64)) for s in (a, b))
        d = nearcopies.apart(x, y)
        assert d <= len(a ^ b) and d >= 0.5 * len(a ^ b)
