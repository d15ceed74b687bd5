"""The pipeline's stages, each on what the one before kept, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearwise.llm import mixing
from nearwise.llm.registry import oracle_sql, queries
from tests.llm.conftest import words
from tests.llm.test_native import kept_lines
from tests.llm.test_text import groups_of, print_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, texts, labels = random.Random(11), [], []
    shared = [words(rng, 9) for _ in range(4)]
    for i in range(400):
        lines = [words(rng, rng.randrange(6, 14)) + "." for _ in range(rng.randrange(2, 8))]
        if i % 9 == 0:
            lines[1:1] = shared
        text = "\n".join(lines)
        if i % 10 == 3:
            text = " ".join(w.upper() + "!!" for w in text.split()[:8] * 6)
        texts.append(texts[i - 7] if i % 25 == 24 else text)
        labels.append((i, int("!!" not in texts[-1]), 0))
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), rows[5]]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.save(stage(spark, kept[-1], folder)))
        assert kept[-1].columns == columns
    rows = [k.collect() for k in kept]
    clean = Counter(r["doc_id"] for r in rows[0] if r["text"] is not None and r["text"] and "!!" not in r["text"])
    assert Counter(r["doc_id"] for r in rows[1] if r["text"]) == clean
    want = kept_lines([(r["doc_id"], r["text"]) for r in rows[1]])
    texts = {r["doc_id"]: r["text"] for r in rows[1]}
    assert len(rows[1]) == len(rows[2])
    for r in rows[2]:
        before = texts[r["doc_id"]]
        assert r["text"] == (None if before is None else want[(r["doc_id"], before)])
        assert r["n_chars"] == (None if before is None else len(r["text"]))
    names, n = groups_of([(r["doc_id"], print_of(r["text"])) for r in rows[2]])
    assert len(rows[3]) == n and {r["doc_id"] for r in rows[3]} == set(names)
    taken = Counter({r["id"]: r["times"] for r in mixing.mix_counts(kept[3]).collect()})
    assert Counter(r["doc_id"] for r in rows[4]) == +taken
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], folder).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == +taken


def test_run_and_registry(spark, folder):
    found = queries()["pipeline"](spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0
    assert {int(q[2:].split("_")[0]) for q in queries() if q != "pipeline"} == set(range(1, 11))
    assert set(oracle_sql()) < set(queries())


def test_no_rows_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    more = docs.limit(60)
    for name in ("line_dedup", "key", "row", "set", "n", "low", "sites", "place"):
        more = more.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = corpus_pipeline.save(stage(spark, more, folder))
        assert all(r[name] == name for r in more.collect() for name in ("line_dedup", "key", "row", "set", "n", "low", "sites", "place"))
    assert corpus_pipeline.STAGES[-1][1](spark, more, folder).count() > 0
