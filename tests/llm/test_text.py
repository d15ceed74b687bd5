"""Substring dedup, SimHash, fingerprints, packing and the scorers against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearwise.llm import minhash, packing, quality, simhash, substrings, toxicity
from nearwise.plans.tables import work_dir
from tests.llm.conftest import SCHEMA, rows_of, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(texts, window=35):
    split = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check_substrings(df, rows):
    got = [(r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()]
    want = [(r[0], *w) for r, w in zip(rows, without_repeats([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substrings(odd, odd_rows, none):
    check_substrings(odd, odd_rows)
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_few_words(spark):
    """Runs, periods and passages that begin and end anywhere."""
    rng = random.Random(3)
    texts = []
    for n in range(60):
        own = [rng.choice("ab" if n % 2 else "abcdefgh") for _ in range(rng.randrange(20, 90))]
        own += ["r"] * rng.choice([0, 3, 34, 35, 36, 50])
        texts.append(" ".join(own))
    passage = [rng.choice("klmnopq") for _ in range(70)]
    for n in range(40):
        low = rng.randrange(36)
        texts.append(" ".join([f"u{n}{i}" for i in range(rng.randrange(20))] + passage[low : low + rng.randrange(30, 50)] + [f"v{n}{i}" for i in range(20)]))
    rows = rows_of(texts)
    check_substrings(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_substrings_of_any_ids_in_many_buckets(spark, odd, odd_rows, monkeypatch):
    """Text as ids; more buckets than shuffle partitions."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    assert substrings._buckets(substrings._texts(odd, "doc_id", "text")[0]) > 30
    named = odd.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    rows = [(None if r[0] is None else f"doc {r[0]}", *r[1:]) for r in odd_rows]
    assert dict(substrings.remove_repeats(named).dtypes)["id"] == "string"
    check_substrings(named, rows)


def test_window_hashes_tell_windows_apart(spark):
    """Both hashes, by definition equal for equal windows only."""
    rng = random.Random(8)
    text = substrings.word_hashes([rng.choice([b"a", b"b"]) for _ in range(3000)] + [b"c", b"d"] * 40)
    at = np.arange(len(text) - 34)
    h, more = substrings.window_hashes(text, at)
    windows = {i: text[i : i + 35].tobytes() for i in at.tolist()}
    assert more.dtype == np.uint32 and len(set(windows.values())) == len(set(h.tolist())) == len(set(more.tolist()))
    assert len(set(zip(windows.values(), h.tolist(), more.tolist(), strict=True))) == len(set(windows.values()))


def test_kept_text(odd):
    for r in substrings.remove_repeats(odd, with_text=True).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert len(r["kept"].split()) == r["n_words"] - r["n_removed"]


def print_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(lowered)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs, bits=3):
    """[(id, fingerprint)] -> id that names each one's group, and the number of groups."""
    label = list(range(len(pairs)))
    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= bits and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    ids = {}
    for x, (i, _) in zip(label, pairs, strict=True):
        ids.setdefault(x, []).append(i)
    return [min([i for i in ids[x] if i is not None], default=None) for x in label], len(ids)


def test_simhash(odd, odd_rows, none):
    prints = [(r[0], print_of(r[1])) for r in odd_rows]
    names, n = groups_of(prints)
    got = sorted(((r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(odd).collect()), key=str)
    assert got == sorted([(i, p, g) for (i, p), g in zip(prints, names, strict=True)], key=str)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == n
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_connect_all_near_fingerprints(spark, tile):
    """Chains, clusters and strangers; a small tile cuts every list."""
    rng, all_ = random.Random(1), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(30):
            all_.add(p)
            for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
                p ^= 1 << rng.randrange(64)
    members = np.array(sorted(all_), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in members.view(np.int64)], "fp long")
    found = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df, 3, tile)).collect()}
    found |= {root: root for root in found.values()}
    want, _ = groups_of([(int(x), int(x)) for x in members])
    group = Counter(want)
    assert {int(x) for x, g in zip(members, want, strict=True) if group[g] > 1} == set(found)
    assert len({(found[int(x)], g) for x, g in zip(members, want, strict=True) if int(x) in found}) == len(set(found.values())) == sum(n > 1 for n in group.values())


def shingles(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints(odd, odd_rows, none):
    got = minhash.print_documents(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["id"]: r for r in got if r["id"] is not None}
    rows = [r for r in odd_rows if r[0] is not None and 7 < r[0] < 15]
    for r, after in zip(rows, rows[1:], strict=False):
        half = len(r[1]) // 2
        new = r[1][: len(r[1]) - half] + after[1][:half]
        found = by_id[r[0]]
        assert (found["n_chars"], found["edited_sha256"]) == (len(r[1]), hashlib.sha256(new.encode()).hexdigest())
        for other, near in ((new, found["near_edited"]), (after[1], found["near_next"])):
            a, b = shingles(r[1]), shingles(other)
            assert abs(near - len(a & b) / max(1, len(a | b))) < 0.15
    same = {}
    for r in got:
        if r["id"] in (0, 4):
            same.setdefault(r["fingerprint"], []).append(r["id"])
    assert len(same) == 1
    assert minhash.print_documents(none).count() == 0


def plain_codes(text, bins=256, bits=8):
    """A fingerprint from the definition: hash once, bin by the high bits, draw for empty bins, mix, cut."""
    hashes = [int(h) for h in minhash.shingle_hashes((text or "").encode())]
    if not hashes:
        return [0] * bins
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    drawn = minhash.draws(bins, 20_000)
    values = [least[b] if b in least else least[next(int(d) for d in drawn[:, b] if int(d) in least)] for b in range(bins)]
    return [int(minhash.mix(np.array([(v + b * int(minhash._ODD[2])) % 2**64], np.uint64))[0]) & (1 << bits) - 1 for b, v in enumerate(values)]


def plain_likeness(a, b):
    if not any(a) or not any(b):
        return float(not any(a) and not any(b))
    m = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (m - 2**-8) / (1 - 2**-8)))


@pytest.mark.parametrize("ids", ["long", "string"])
def test_all_columns_of_fingerprints(spark, odd_rows, ids):
    """Nulls, repeated ids and the wrap from the last row to the first, by definition."""
    texts = [t for _, t, *_ in odd_rows if len(t or "") < 3000]
    rows = [(None if n % 9 == 4 else n // 2, t) for n, t in enumerate(texts)]
    if ids == "string":
        rows = [(None if i is None else f"d{i:03}", t) for i, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {ids}, text string").repartition(3)
    hashed = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or ("" if ids == "string" else 0), hashed[r[1]]))
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = plain_codes(text), plain_codes(new), plain_codes(after)
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), plain_likeness(a, b), plain_likeness(a, c)))
    got = [tuple(r) for r in minhash.print_documents(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_likeness_has_no_bias():
    rng, off = random.Random(2), []
    for n in (6, 30, 200, 1500):
        for share in (0.2, 0.5, 0.9):
            a = [f"a{rng.getrandbits(40)}" for _ in range(n)]
            b = a[: int(n * share)] + [f"b{rng.getrandbits(40)}" for _ in range(n - int(n * share))]
            x, y = (" ".join(v) for v in (a, b))
            s, t = shingles(x), shingles(y)
            off.append(minhash.likeness(*(minhash.fingerprint(v.encode()) for v in (x, y))) - len(s & t) / len(s | t))
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.08
    empty, one = minhash.fingerprint(b""), minhash.fingerprint(b"x")
    assert minhash.likeness(empty, empty) == 1 and minhash.likeness(empty, one) == 0
    assert minhash.pack(np.array([1, 0, 1, 1], np.uint8), 1) == "0d"


def test_packing(odd, odd_rows, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] not in (0, 3, 6)}
    got = packing.pack(odd, with_ids=True).collect()
    for i, text in texts.items():
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["start"])
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x for r in mine for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in mine)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in mine)
    # rows of one id, with one piece each
    short = Counter((r[0], (*tokens.encode(r[1] or "", add_special_tokens=False).ids, 1)) for r in odd_rows if len(r[1] or "") < 3000)
    assert Counter((r["id"], tuple(r["ids"])) for r in got if r["id"] != 15) == short
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(none).count() == 0
    named = packing.pack(odd.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))).collect()
    assert Counter((r["id"], r["ids_crc32"]) for r in named) == Counter((None if r["id"] is None else f"doc {r['id']}", r["ids_crc32"]) for r in got)


def test_packing_of_long_runs_and_bad_bytes(spark):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.default_vocabulary())
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bad = df.limit(0).union(spark.sql("SELECT 9L, CAST(X'61FF62' AS STRING)"))
    got = packing.pack(df.union(bad), with_ids=True).collect()
    for i, text in [*enumerate(texts), (9, "a\ufffdb")]:
        mine = sorted((r["start"], r["ids"]) for r in got if r["id"] == i)
        assert [x for _, ids in mine for x in ids] == [*tokens.encode(text, add_special_tokens=False).ids, 1]


def test_fast_ids_are_the_library_s():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ids, tokens = packing._coder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    texts = ["", " ", "a  b\t\n\n c", "x <|endoftext|> y", "don't WE'LL 'S", "漢字 😀 ½ Ⅷ", "\x00\x1c\x85\xa0 z", "é́ ñandú — „ß“", "9" * 50, "ab" * 3000]
    texts += [f"{c} {c}{c}a{c}1{c}" for c in map(chr, [*range(1, 0x378, 3), *range(0x400, 0x530, 3)])]
    assert all(ids(t) == tokens.encode(t, add_special_tokens=False).ids for t in texts)


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 20000):
        sizes, counts = np.unique(rng.integers(1, 257, n), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        found, held = packing.patterns(histogram, 256), Counter()
        for pattern, times in found:
            assert sum(s * k for s, k in pattern) <= 256
            for s, k in pattern:
                held[s] += k * times
        assert all(held[s] >= c for s, c in histogram.items())
        assert sum(t for _, t in found) <= -(-(sizes @ counts) // 256) * 1.1 + 2


@pytest.fixture(scope="module")
def labelled(spark):
    """Junk repeats one word or shouts; toxic documents have words of their own."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        good, toxic = rng.random() < 0.8, rng.random() < 0.3
        text = words(rng, rng.randrange(30, 120)) + ". Done."
        if toxic:
            text = " ".join([text, *rng.sample(["vexmoro", "vexlit", "grubscum", "vexdan"], 2)])
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()[:12] * 5)
        rows.append((i, text, "en", f"s{i % 5}", len(text), "k", "i", 7, 8, 9))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, odd, odd_rows, none):
    docs, labels = labelled
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    found = quality.classify(docs, labels).collect()
    assert np.mean([(r["posterior"] >= 0.5) == known[r["id"]] for r in found]) > 0.97
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(odd, labels).count() == len(odd_rows)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("posterior is null").count() == 0


def plain_posteriors(rows, share):
    """[(sites, logit)] -> [(host_rate, path_rate, posterior)], by sums over all rows for each row."""
    p = [1 / (1 + np.exp(-z)) for _, z in rows]
    n, levels = len(rows), len(rows[0][0])
    mean = min(max(sum(p) / n, 1e-3), 1 - 1e-3)
    counts = [Counter(sites[level] for sites, _ in rows) for level in range(levels)]
    sums = [{site: sum(x for x, (sites, _) in zip(p, rows, strict=True) if sites[level] == site) for site in c} for level, c in enumerate(counts)]
    rates, strengths = [], []
    for level in range(levels):
        ups = {sites[level]: rates[level - 1][sites[level - 1]] if level else mean for sites, _ in rows}
        spread = sum(counts[level][x] * (sums[level][x] / counts[level][x] - ups[x]) ** 2 for x in ups) / n
        variance = max(spread - mean * (1 - mean) * len(ups) / n, 1e-9)
        k = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e4)
        strengths.append(k)
        rates.append({x: (k * ups[x] + sums[level][x]) / (k + counts[level][x]) for x in ups})
    out = []
    for own, (sites, z) in zip(p, rows, strict=True):
        prior = mean
        for level, k in enumerate(strengths):
            prior = (k * prior + sums[level][sites[level]] - own) / (k + counts[level][sites[level]] - 1)
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        odds = z - np.log(share / (1 - share)) + np.log(prior / (1 - prior))
        out.append((rates[0][sites[0]], rates[-1][sites[-1]], 1 / (1 + np.exp(-odds))))
    return out


@pytest.mark.parametrize("levels", [2, 3])
def test_posteriors(spark, levels):
    rng = random.Random(levels)
    rows = [(["alone"] * levels, 1.0)]
    for h in range(40):
        good = rng.choice([-2.0, 2.0])
        for _ in range(rng.choice([1, 2, 30])):
            parts = [f"h{h}", rng.choice("ab"), rng.choice("xyz")][:levels]
            rows.append((["/".join(parts[: n + 1]) for n in range(levels)], rng.gauss(good, 2)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, sites array<string>, logit double").repartition(3)
    got = sorted((r["id"], r["host_rate"], r["path_rate"], r["posterior"]) for r in quality.posteriors(df, 0.4, levels).collect())
    assert len(got) == len(rows)
    for (_, *found), want in zip(got, plain_posteriors(rows, 0.4), strict=True):
        assert np.allclose(found, want, rtol=0, atol=1e-9)


def test_own_share_is_no_evidence(spark):
    """A document alone in its host, among as many good hosts as bad ones, has the global prior."""
    rows = [(["alone", "alone/a"], 1.0)] + [([f"h{h}", f"h{h}/a"], 6.0 if h % 2 else -6.0) for h in range(40) for _ in range(20)]
    alone = [r for r in quality.posteriors(spark.createDataFrame(rows, "sites array<string>, logit double"), 0.5, 2).collect() if r["sites"][0] == "alone"]
    assert abs(alone[0]["posterior"] - 1 / (1 + np.exp(-1))) < 0.005


def test_sites_of_urls(spark):
    urls = ["https://A.org/x/Y/doc.html?q=/1", "https://a.org/x/", "http://b.net", None, "", "c.org/one#/two"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(quality.url_sites(F.col("u"), 3)).collect()]
    assert got[0] == ["a.org", "a.org/x", "a.org/x/Y"] and got[1] == ["a.org", "a.org/x", "a.org/x/"] and got[2] == ["b.net", "b.net/", "b.net/"]
    assert len({g[0] for g in got}) == 5 and all(len(g) == 3 and None not in g for g in got)


def plain_evidence(rows):
    """[(different words, toxic)] -> what is known (a beginning, or a word and True) -> its evidence, from counts in
    dictionaries and the formulas of interpolated Kneser-Ney."""
    counts = {}
    for text, toxic in rows:
        for w in set(text):
            for node in [(w[:k], False) for k in range(1, min(len(w), 8) + 1)] + [(w, True)]:
                counts.setdefault(node, [0, 0])[toxic] += 1
    up = lambda node: (node[0][:8], False) if node[1] else (node[0][:-1], False)
    below, types = {}, Counter()
    for node in counts:
        below.setdefault(up(node), []).append(node)
        types["rest" if node[1] and len(node[0]) > 8 else "end" if node[1] else node[0][-1]] += 1
    low = lambda node: 1 / (types["rest"] + 1) if node[1] and len(node[0]) > 8 else types["end" if node[1] else node[0][-1]] / (types.total() - types["rest"])
    so_far, out, todo = {(b"", False): 0.0}, {}, [(b"", False)]
    while todo:
        at = todo.pop()
        next_ = below.get(at, [])
        total = [sum(counts[n][c] for n in next_) for c in (0, 1)]
        rest = [max(1e-6, 1 - sum(max(counts[n][c] - 3.0, 0) for n in next_) / total[c]) if total[c] else 1.0 for c in (0, 1)]
        shared_rest = 1 - sum(max(sum(counts[n]) - 0.75, 0) for n in next_) / sum(total) if sum(total) else 1.0
        out[at] = so_far[at] + np.log(rest[1] / rest[0])
        for n in next_:
            shared = max(sum(counts[n]) - 0.75, 0) / sum(total) + shared_rest * low(n)
            own = [(max(counts[n][c] - 3.0, 0) / total[c] if total[c] else 0.0) + rest[c] * shared for c in (0, 1)]
            so_far[n] = so_far[at] + np.log(own[1] / own[0])
            if n[1]:
                out[n] = so_far[n]
            else:
                todo.append(n)
    return out


def plain_measures(known, words, least):
    def of(w):
        if (w, True) in known:
            return known[(w, True)]
        return next(known[(w[:k], False)] for k in range(min(len(w), 8), -1, -1) if (w[:k], False) in known)

    found = [(e, n) for w, n in Counter(words).items() if abs(e := of(w)) >= least]
    top = sorted((max(e, 0.0) for e, _ in found), reverse=True)[:3]
    return [max(top, default=0.0), sum(top) / 3, sum(e * n for e, n in found) / max(1, len(words)), sum(e for e, _ in found) / max(1, len(set(words)))]


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_kneser_ney_by_definition(spark, least):
    """Evidence and measures, against sums over dictionaries; all documents are labelled and none is held out."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    texts = []
    for i in range(120):
        toxic = i % 3 == 0
        picked = [rng.choice(stems[:9] if not toxic or rng.random() < 0.7 else stems[6:]) + rng.choice(["", "x", "yz", "longending"]) for _ in range(rng.randrange(0, 30))]
        texts.append((i, " ".join(picked).upper() if i % 5 == 0 else " ".join(picked), int(toxic)))
    df = spark.createDataFrame(texts, "id long, text string, y int").repartition(3)
    rows = df.select(F.col("text").cast("binary").alias("text"), (F.when(F.col("id") % 2 == 0, 0).otherwise(2) + F.col("y")).alias("group"))
    known = toxicity.evidence(*toxicity.counted(rows)).cache()
    split = lambda t: t.lower().encode().split()
    plain = [plain_evidence([(split(t), y) for i, t, y in texts if i % 2 in use]) for use in ((1,), (0,), (0, 1))]
    got = {(r["kind"], r["key"]): r["e2"] for r in known.collect()}
    keys = lambda w: [(9, int(toxicity.keys_of([w])[0].view(np.int64)[0]))] + [(k, int(toxicity.keys_of([w[:k]])[1].view(np.int64)[0])) for k in range(min(len(w), 8), 0, -1)]
    assert 100 < len(got) < len(plain[2])
    for (start, whole), e in plain[2].items():
        # what is left out has the evidence of the last beginning that is there
        assert abs(next(got[k] for k in [*(keys(start)[0 if whole else 1 :] if start else []), (0, 0)] if k in got) - e) < 1e-9
    docs = df.union(spark.createDataFrame([(200, None, 0), (201, "", 0), (202, "unseen abcunseen", 0)], df.schema))
    keyed = toxicity._keyed(docs, "id", "text")
    ids = {(r["key"], r["more"]): (r["id"], r["text"]) for r in keyed.collect()}
    found = {(ids[(r["key"], r["more"])][0], r["model"]): r["x"] for r in toxicity.measures(keyed, known, least).collect()}
    for i, text in ids.values():
        for m in range(3):
            want = plain_measures(plain[m], split((text or b"").decode()), max(least, 1e-12))
            assert np.allclose(found.get((i, m), [0.0] * 4), want, rtol=0, atol=1e-9), (i, m)


def test_every_word_counts(spark, monkeypatch):
    """Words of little evidence move the measures of a default run, and few held rows change nothing."""
    texts = [(i, f"alpha beta {'gamma' if i % 4 < (2 if i % 3 else 3) else 'delta'} w{i % 7}", int(i % 3 == 0)) for i in range(180)]
    df = spark.createDataFrame(texts, "id long, text string, y int").repartition(3)
    rows = df.select(F.col("text").cast("binary").alias("text"), (F.when(F.col("id") % 2 == 0, 0).otherwise(2) + F.col("y")).alias("group"))
    known = toxicity.evidence(*toxicity.counted(rows)).cache()
    of = lambda: {(r["key"], r["more"], r["model"]): r["x"] for r in toxicity.measures(toxicity._keyed(df, "id", "text"), known, toxicity.LEAST).collect()}
    all_held = of()
    assert len(all_held) == 180 * 3 and all(x[2] != 0 and x[3] != 0 for x in all_held.values()) and max(x[0] for x in all_held.values()) < 3
    for most in (0, 12):
        monkeypatch.setattr(toxicity, "MAX_HELD", most)
        few = of()
        assert few.keys() == all_held.keys() and all(np.allclose(few[k], all_held[k], rtol=0, atol=1e-9) for k in few)


def test_words_are_handed_out_for_one_model(spark, monkeypatch, labelled):
    """Rows with a model are read with that one only, whatever is held and however often they are there; a run leaves
    no tables behind that nothing reads."""
    texts = [(i % 150, f"alpha beta {'gamma' if i % 4 < (2 if i % 3 else 3) else 'delta'} w{i % 5}", int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(texts + texts[:9], "id long, text string, y int").repartition(3)
    rows = df.select(F.col("text").cast("binary").alias("text"), (F.when(F.col("id") % 2 == 0, 0).otherwise(2) + F.col("y")).alias("group"))
    known = toxicity.evidence(*toxicity.counted(rows)).cache()
    keyed = toxicity._keyed(df, "id", "text")
    of = lambda rows: {(r["key"], r["more"], r["model"]): r["x"] for r in toxicity.measures(rows, known, toxicity.LEAST).collect()}
    every = of(keyed)
    monkeypatch.setattr(toxicity, "MAX_HELD", 0)
    mine = of(keyed.withColumn("model", F.pmod("id", F.lit(3)).cast("int")))
    assert len(every) == 450 and len(mine) == 150 and {m for *_, m in mine} == {0, 1, 2}
    assert all(np.allclose(mine[k], every[k], rtol=0, atol=1e-9) for k in mine)
    work = Path(urlparse(work_dir(spark)).path).parent
    before = len(list(work.iterdir()))
    assert toxicity.score(*labelled).count() == labelled[0].count()
    assert len(list(work.iterdir())) - before == 5  # labels, evidence, the curve's ids and keys, measures


def test_toxicity(labelled, odd, odd_rows, none):
    docs, labels = labelled
    known = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null and doc_id is not null").collect()}
    found = toxicity.score(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert np.mean([r["predicted"] == known[r["id"]] for r in held]) > 0.9
    assert toxicity.score(odd, labels).count() == len(odd_rows)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(odd, labels.limit(0)).where("predicted <> 0").count() == 0
