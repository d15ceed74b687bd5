"""Mixing, line dedup and the fixity audit against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nearwise.llm import fixity, lines, mixing
from tests.llm.conftest import SCHEMA


def levels(sizes, weights, cap=3):
    """Shares by weight, what is above the cap shared again."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(target.values())
        unit = left / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if unit * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weights[s] for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mix(spark, odd, odd_rows):
    got = mixing.mix_counts(odd).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = levels(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    targets = Counter((r["source_size"], round(r["target"], 6)) for r in got)
    assert set(targets) == {(sizes[s], round(want[s], 6)) for s in order}
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_counts(odd.repartition(5)).collect()), key=str)


def test_mix_documents_takes_what_it_counts(odd, none):
    taken = Counter(r["id"] for r in mixing.mix_counts(odd).collect() for _ in range(r["times"]))
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == taken
    assert mixing.mix_counts(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 4}", 0, "", "", 0, 0, 0) for i in range(6000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, SCHEMA)).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 4 and all(abs(r["taken"] - r["target"]) <= 20 for r in got)


def kept_lines(rows):
    """Later occurrences, by id (null first) and text hash, of three lines go."""
    docs = {(r[0], r[1]) for r in rows if r[1] is not None}
    seen = defaultdict(list)
    for id_, text in docs:
        ls = text.split("\n")
        for p in range(len(ls) - 2):
            seen[tuple(ls[p : p + 3])].append((id_ is not None, id_ or 0, text, p))
    gone = defaultdict(set)
    for places in seen.values():
        for _, id_, text, p in sorted(places)[1:]:
            gone[(id_, text)].update((p, p + 1, p + 2))
    return {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(i or 0, t)]) for i, t in docs}


def test_lines(odd, odd_rows, none):
    want = kept_lines(odd_rows)
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "line_dedup"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if r["text"] is None:
            assert r["line_dedup"]["text"] is None and r["line_dedup"]["n_lines"] == 0
        else:
            assert r["line_dedup"]["text"] == want[(r["doc_id"], r["text"])]
    assert any(r["line_dedup"]["n_removed"] for r in rows)
    assert lines.dedup_lines(got).columns == got.columns
    assert lines.dedup_lines(none).count() == 0


PAGES = "page_id long, url string, html string, archive long, hash string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i * 7}</p>" * (i % 5), 1, "x") for i in range(2600)]
    rows += [(None, None, None, None, None), (None, "u", None, None, None), (5, "again", "é", 1, "x"), (5, "again", "é", 1, "x")]
    return spark.createDataFrame(rows, PAGES)


def differing(rows):
    return sorted((r["id"], r["status"], r["records"]) for r in rows if r["status"] != "intact")


def test_audit_finds_what_differs(spark, pages):
    good = fixity.leaves(pages)
    assert good.agg(F.sum("copies")).first()[0] == pages.count()
    same = fixity.audit(good, fixity.leaves(pages.repartition(7)))
    assert same.count() == 0
    assert sum(r["records"] for r in fixity.audited(good, good).collect()) == pages.count()


@pytest.mark.parametrize("many", [64, 1])
def test_audit_in_the_middle_of_an_archive(spark, pages, many, monkeypatch):
    """A changed, a lost and an added record are one row each, and the records after them are intact."""
    monkeypatch.setattr(fixity, "MANY", many)
    good = fixity.leaves(pages)
    html = F.when(F.col("page_id").isin(3, 1700), F.lit("longer than it was before")).otherwise(F.col("html"))
    assert differing(fixity.audited(good, fixity.leaves(pages.withColumn("html", html))).collect()) == [(3, "corrupt", 1), (1700, "corrupt", 1)]
    assert differing(fixity.audited(good, fixity.leaves(pages.where("page_id is null or page_id <> 300"))).collect()) == [(300, "missing", 1)]
    less = fixity.leaves(pages.where("page_id is null or page_id <> 1300"))
    assert differing(fixity.audited(less, good).collect()) == [(1300, "extra", 1)]
    more = pages.union(spark.createDataFrame([(-5, "u", "h", 1, "x"), (9_000_000, "u", "h", 1, "x"), (5, "again", "é", 1, "x"), (5, "new", "é", 1, "x")], PAGES))
    assert differing(fixity.audited(good, fixity.leaves(more)).collect()) == [(-5, "extra", 1), (5, "extra", 1), (5, "extra", 1), (9_000_000, "extra", 1)]
    fewer = fixity.leaves(more.where("not (page_id <=> 5 and url = 'again')"))
    assert differing(fixity.audited(fixity.leaves(more), fewer).collect()) == [(5, "missing", 3)]
    # of an id's records some are changed, one is lost
    swapped = more.where("not (page_id <=> 5 and url = 'new')").withColumn("url", F.when(F.col("url") == "again", "other").otherwise(F.col("url")))
    found = differing(fixity.audited(fixity.leaves(more), fixity.leaves(swapped)).collect())
    assert {i for i, _, _ in found} == {5} and sum(n for _, s, n in found if s == "corrupt") == 3 and sum(n for _, s, n in found if s == "missing") == 1
    rows = fixity.audited(good, fixity.leaves(pages.where("page_id is not null or url is not null"))).collect()
    assert [(r["id"], r["archive"], r["status"]) for r in rows if r["status"] != "intact"] == [(None, None, "missing")]


def test_audit_of_nothing(spark, pages):
    none = fixity.leaves(pages.limit(0))
    assert fixity.audited(none, none).count() == 0
    some = fixity.leaves(pages.limit(9))
    assert {r["status"] for r in fixity.audited(some, none).collect()} == {"missing"}
    assert {(r["status"], r["start"]) for r in fixity.audited(none, some).collect()} == {("extra", None)}


def test_records_and_offsets(pages):
    leaf = {r["id"]: r for r in fixity.offsets(fixity.leaves(pages.where("page_id between 1000 and 1003"))).collect()}
    record = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1001>\r\nWARC-Target-URI: http://h/1001\r\nContent-Length: 11\r\n\r\n<p>7007</p>\r\n\r\n"
    assert leaf[1001]["hash"] == hashlib.sha256(record.encode()).hexdigest()
    assert leaf[1000]["start"] == 0 and leaf[1001]["start"] == leaf[1000]["stop"] and leaf[1001]["stop"] - leaf[1001]["start"] == len(record)


def test_nodes_hash_offsets_and_hashes(spark):
    """One range of ids by hand."""
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(3)], "page_id long, url string, html string")
    rows = fixity.offsets(fixity.leaves(pages)).orderBy("id").collect()
    text = "".join(f"{r['start']}:{r['stop']}:{r['hash']}\n" for r in rows)
    level = fixity.leaves(pages).withColumn("side", F.lit(0)).withColumn("prefix", F.lit(""))
    node = fixity._fold(level, {"place": F.floor(F.col("place") / 16).cast("long")}).first()
    assert node["hash"] == hashlib.sha256(text.encode()).hexdigest() and node["size"] == rows[-1]["stop"]
