"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, read from its start: its beginnings of 1 to PREFIX bytes one after the other, then the
word itself. For each class (toxic, ordinary) all labelled documents that are not held out are counted that
have an expression; nothing is left out, whatever its count. What follows a beginning has, under a class, its
own count there less a discount; the discounted mass goes to a distribution that both classes share, the
interpolated Kneser-Ney one of their joint counts, whose lowest order is in how many different beginnings a
byte (or a word's end) follows. So a rare expression is judged by the beginnings it shares with others, and
where a class has no counts of its own it gives no evidence. A word's evidence is the difference of its
log-likelihoods under both classes, summed along its beginnings down to the last one that is known. Every word
counts, however little its evidence (`least` is 0 nats; what neither class knows leans by some two nats to the class
with fewer documents, whose discounted mass is greater). A document has four measures: the greatest evidence of a word,
the mean of the three greatest, and its log-likelihoods' difference over all its words, divided by their number
(repeats included), and over its different words, divided by theirs. A logistic curve turns these into a score.
For that curve, labelled documents of either half are read with the counts of the other half, so no document is
judged by counts it is part of; at most `max_curve` labelled documents are used.

Counts are written tables; likelihoods are found by joins, of all levels together: each level's own would fill the driver with
plans and their threads. All documents are read with the counts of
both halves, those of the curve once more with the other half's, with a bitmap of fixed size (4 MB) of what is known
and the evidence of what most documents have, at most MAX_HELD rows of it (17 MB; 6 MB more for the halves). A word
whose deepest beginning in the bitmap is among those rows is resolved where it is read and summed there. All others
(beyond those rows, or where keys fall together in the bitmap) are handed out, once for each document that has them; the
different ones are resolved in the tables, from the deepest beginning that is held on, and their evidence is joined and
added. So the bounds cost exchanges, never evidence. Nothing that grows with the corpus is broadcast without a count or
reaches the driver. Work tables are deleted as soon as nothing reads them.

Scores use nothing but the text. Defined cases: a null text is an empty one; bytes that are no UTF-8 are read
as U+FFFD; a text without words, or without evidence, has measures of 0; null labels do not count, of several for
one id the greatest holds; without labels of both classes the score is constant; rows with one id are scored one
by one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwise.plans.tables import discard

from .common import attach, batches_of, save, tidy_shuffles
from .logistic import Logistic, fit
from .minhash import mix

PREFIX, DISCOUNT, CLASS_DISCOUNT, LEAST, MAX_CURVE, TOXIC_AT, LABELS_BROADCAST, TABLE_BROADCAST = 8, 0.75, 3.0, 0.0, 20_000, 0.7, 300_000, 20_000
#: The kind of a whole word; beginnings have their number of bytes.
WHOLE, FILTER_BITS = PREFIX + 1, 25
#: Counts by half and class; each half is read with the other's, and all documents with both.
GROUPS, MODELS = 4, ((2, 3), (0, 1), (0, 1, 2, 3))
#: The model that all documents are read with.
ALL = 2
MEASURES = 4
#: Documents that counting workers get at once, whose counts are sent on together.
COUNT_BATCH = 2000
#: Rows of evidence that readers of documents hold; documents that workers get at once; how fine counts are told apart.
MAX_HELD, BATCH, STEPS = 1 << 20, 500, 8
_KINDS = mix(np.arange(WHOLE + 1, dtype=np.uint64))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased, in order."""
    return (text or b"").decode(errors="replace").lower().encode().split()


def keys_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: a hash, the first PREFIX bytes as a number (the first byte lowest), the number of bytes, WHOLE if
    there are more than PREFIX."""
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    first = np.frombuffer(b"".join([w[:PREFIX].ljust(PREFIX, b"\0") for w in words]), "<u8")
    return whole, first, np.minimum(np.fromiter(map(len, words), np.int64, len(words)), WHOLE)


def place_of(kind: int, key: np.ndarray) -> np.ndarray:
    """Of keys in the bitmap."""
    return (mix(key ^ _KINDS[kind]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: text, group -> how many documents of each group have each word, summed per batch."""
    for batch in batches:
        found: dict[int, Counter] = {}
        for text, group in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found.setdefault(group, Counter()).update(set(words_of(text.as_py())))
        for group, counts in found.items():
            whole, first, size = keys_of(list(counts))
            columns = [whole.view(np.int64), first.view(np.int64), size.astype(np.int32), np.full(len(size), group, np.int32), np.fromiter(counts.values(), np.int64, len(size))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["whole", "first", "size", "group", "seen"])


def _mask(kind: int) -> int:
    return -1 if kind >= PREFIX else (1 << 8 * kind) - 1


def _n(model: tuple[int, ...], toxic: int | None = None) -> Column:
    """How many documents of a model's class, or of both."""
    return sum((F.col(f"n{g}") for g in model if toxic is None or g % 2 == toxic), F.lit(0)).cast("double")


_COUNTS = [f"n{g}" for g in range(GROUPS)]


def _part(first: Column, kind: Column) -> Column:
    """The beginning of that many bytes."""
    return first.bitwiseAND(F.get(F.array(*[F.lit(_mask(k)).cast("long") for k in range(PREFIX + 1)]), kind))


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows: text (binary), group -> words (whole, first, size, n0 .. n3) and the beginnings of all numbers of bytes,
    none included (kind, key, n0 .. n3), and of what follows each, by model, the discounted counts of the classes (k) and
    the number of different ones (d). All levels are summed together, so the number of jobs is small. Written."""
    sums = [F.sum(F.when(F.col("group") == g, F.col("seen")).otherwise(0)).alias(f"n{g}") for g in range(GROUPS)]
    with batches_of(rows.sparkSession, COUNT_BATCH):
        words = rows.mapInArrow(_count, "whole long, first long, size int, group int, seen long")
        words = save(words.groupBy("whole", "first", "size").agg(*sums))
    above = [F.sum(c).alias(c) for c in _COUNTS]
    starts = words.select(F.explode(F.sequence(F.lit(1), F.least("size", F.lit(PREFIX)))).alias("kind"), "first", *_COUNTS)
    starts = starts.groupBy("kind", _part(F.col("first"), F.col("kind")).alias("key")).agg(*above)
    above += [F.sum(F.greatest(_n(MODELS[m], c) - CLASS_DISCOUNT, F.lit(0.0))).alias(f"k{m}{c}") for m in range(len(MODELS)) for c in (0, 1)]
    above += [F.count_if(_n(model) > 0).alias(f"d{m}") for m, model in enumerate(MODELS)]
    # after a beginning come longer ones, and words that end there
    ends = words.select(F.least("size", F.lit(PREFIX)).alias("kind"), F.col("first").alias("key"), *_COUNTS)
    ends = ends.unionByName(starts.select((F.col("kind") - 1).alias("kind"), _part(F.col("key"), F.col("kind") - 1).alias("key"), *_COUNTS))
    with tidy_shuffles(rows.sparkSession):
        return words, save(ends.groupBy("kind", "key").agg(*above))


def _last() -> Column:
    """Of a beginning: its last byte."""
    return F.expr("cast(shiftrightunsigned(key, 8 * (kind - 1)) & 255L as int)")


def _follows(words: DataFrame, nodes: DataFrame) -> list[float]:
    """The lowest order: after how many different beginnings each byte, or a word's end (256), comes, as shares;
    and the share of each of the rests of longer words (257)."""
    lasts = words.select(F.when(F.col("size") > PREFIX, 257).otherwise(256).alias("last")).unionByName(nodes.where("kind > 0").select(_last().alias("last")))
    found = Counter({r["last"]: r["count"] for r in lasts.groupBy("last").count().collect()})  # 258 rows at most
    total = max(1, found.total() - found[257])
    return [*(found[b] / total for b in range(257)), 1 / (found[257] + 1)]


def evidence(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of counts: kind, key, first, seen, e0, e1, e2: how many documents have it, and for each model the evidence of a word that is known (kind WHOLE), or
    whose last known beginning this is. What no class has more than CLASS_DISCOUNT times has, by the formulas,
    exactly the evidence of something unknown after the same beginning, and so has all that follows it: such rows
    are counted above, but need none here. The steps of all levels are found together, then summed along each beginning from
    its first byte on. Written."""
    follows = F.array(*map(F.lit, _follows(words, nodes)))
    three = range(len(MODELS))
    often = (_n(MODELS[-1], 0) > CLASS_DISCOUNT) | (_n(MODELS[-1], 1) > CLASS_DISCOUNT)

    # of a beginning, what its followers' steps need: counts and rests (the discounted mass) of the classes, of both
    held, unknown = [], []
    for m, model in enumerate(MODELS):
        n = [_n(model, c) for c in (0, 1)]
        own = [F.greatest(F.when(n[c] > 0, 1 - F.col(f"k{m}{c}") / n[c]).otherwise(1.0), F.lit(1e-6)) for c in (0, 1)]
        shared = F.when(n[0] + n[1] > 0, DISCOUNT * F.col(f"d{m}") / (n[0] + n[1])).otherwise(1.0)
        held += [F.greatest(n[c], F.lit(1.0)).alias(f"t{m}{c}") for c in (0, 1)] + [own[c].alias(f"r{m}{c}") for c in (0, 1)] + [shared.alias(f"r{m}"), _n(model).alias(f"t{m}")]
        unknown.append(F.log(own[1] / own[0]).alias(f"u{m}"))

    def step(m: int) -> Column:
        shared = F.greatest(_n(MODELS[m]) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"t{m}"), F.lit(1.0)) + F.col(f"r{m}") * F.get(follows, F.col("last"))
        own = [F.greatest(_n(MODELS[m], c) - CLASS_DISCOUNT, F.lit(0.0)) / F.col(f"t{m}{c}") + F.col(f"r{m}{c}") * shared for c in (0, 1)]
        return F.when(F.col(f"t{m}") > 0, F.log(own[1] / own[0])).otherwise(0.0)

    ups = nodes.where(often | (F.col("kind") == 0)).select(F.col("kind").alias("up_kind"), F.col("key").alias("up"), *held)
    longer = nodes.where(often & (F.col("kind") > 0)).withColumns({"first": F.col("key"), "up_kind": F.col("kind") - 1, "last": _last()})
    longer = longer.withColumn("up", _part(F.col("key"), F.col("up_kind"))).select("kind", "key", "first", "up_kind", "up", "last", *_COUNTS, *unknown)
    ended = words.where(often).select(F.lit(WHOLE).alias("kind"), F.col("whole").alias("key"), "first", F.least("size", F.lit(PREFIX)).alias("up_kind"), F.col("first").alias("up"), F.when(F.col("size") > PREFIX, 257).otherwise(256).alias("last"), *_COUNTS)
    steps = longer.unionByName(ended, allowMissingColumns=True).join(ups, ["up_kind", "up"])
    steps = save(steps.select("kind", "key", "first", "up_kind", "up", _n(MODELS[-1]).alias("seen"), *[step(m).alias(f"s{m}") for m in three], *[f"u{m}" for m in three]))
    longer = steps.where(F.col("kind") < WHOLE)
    along = longer.select(F.col("kind").alias("of"), F.col("key").alias("whole"), F.explode(F.sequence(F.lit(1), "kind")).alias("kind"))
    along = along.withColumn("key", _part(F.col("whole"), F.col("kind"))).join(longer, ["kind", "key"])
    # one step of each length, added in their order, so that reruns agree to the last bit
    sums = [reduce(lambda c, k: c + F.coalesce(F.max(F.when(F.col("kind") == k, F.col(f"s{m}"))), F.lit(0.0)), range(1, PREFIX + 1), F.lit(0.0)).alias(f"c{m}") for m in three]  # noqa: B023
    ends = [F.max(F.when(F.col("kind") == F.col("of"), F.col(c))).alias(c) for c in ("seen", *[f"u{m}" for m in three])]
    with tidy_shuffles(words.sparkSession):
        summed = save(along.groupBy(F.col("of").alias("kind"), F.col("whole").alias("key")).agg(*sums, *ends))
    root = nodes.where("kind = 0").select("kind", "key", F.col("key").alias("first"), _n(MODELS[-1]).alias("seen"), *[u.alias(f"e{m}") for m, u in enumerate(unknown)])
    longer = summed.select("kind", "key", F.col("key").alias("first"), "seen", *[(F.col(f"c{m}") + F.col(f"u{m}")).alias(f"e{m}") for m in three])
    ups = summed.select(F.col("kind").alias("up_kind"), F.col("key").alias("up"), *[f"c{m}" for m in three])
    ended = steps.where(F.col("kind") == WHOLE).join(ups, ["up_kind", "up"]).select("kind", "key", "first", "seen", *[(F.col(f"c{m}") + F.col(f"s{m}")).alias(f"e{m}") for m in three])
    out = save(root.unionByName(longer).unionByName(ended))
    discard(steps, summed)
    return out


def _clear(least: float) -> Column:
    return F.greatest(*[F.abs(F.col(f"e{m}")) for m in range(len(MODELS))]) >= least


def _hits(bits: np.ndarray, kind: int, key: np.ndarray) -> np.ndarray:
    at = place_of(kind, key)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _bitmap(known: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the keys set."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            at = np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                at[kind == k] = place_of(k, key[kind == k].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])  # Spark counts bitmap places from 1

    at = known.select("kind", "key").mapInArrow(places, "at long")
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in blocks.toLocalIterator():
        low = (r["block"] - 1) * 4096
        out[low : low + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _held(known: DataFrame) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By model and kind: sorted keys and the evidence of each, of the rows that most documents have: MAX_HELD for all
    documents' model, a quarter of them for those that only the curve's documents are read with."""
    step = F.floor(F.log2(F.greatest("seen", F.lit(1.0))) * STEPS).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in known.groupBy(step.alias("step")).count().collect()), reverse=True)  # 8 rows a doubling
    out: list = [None] * len(MODELS)
    for models, most in ((range(ALL), MAX_HELD // 4), (range(ALL, ALL + 1), MAX_HELD)):
        least, total = 1 << 30, 0
        for at, n in sizes:
            if (total := total + n) > most:
                break
            least = at
        rows = known.where(step >= least).select("kind", "key", *[f"e{m}" for m in models]).toArrow()
        kind, key, *of = (rows.column(c).to_numpy() for c in range(2 + len(models)))
        del rows
        kinds = []
        for k in range(WHOLE + 1):
            at = np.flatnonzero(kind == k)
            kinds.append(at[np.argsort(key[at].view(np.uint64))])
        for m, e in zip(models, of, strict=True):
            out[m] = [(key[at].view(np.uint64), e[at]) for at in kinds]
    return out


def _key_of(kind: int, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
    return whole if kind == WHOLE else first & np.uint64(_mask(kind) % 2**64)


def _deepest(words: list[bytes], bits: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Of words: their keys; the deepest kind that the bitmap has of each, -1 for none."""
    keys = whole, first, size = keys_of(words)
    deepest, going = np.full(len(words), -1), np.arange(len(words))
    # what is known has known beginnings, so a key that only falls together with one is mostly found out by its own
    for kind in range(PREFIX + 1):
        going = going[(size[going] >= kind) & _hits(bits, kind, _key_of(kind, whole[going], first[going]))]
        deepest[going] = kind
    ended = np.flatnonzero(deepest == np.minimum(size, PREFIX))
    deepest[ended[_hits(bits, WHOLE, whole[ended])]] = WHOLE
    return keys, deepest


def _resolve(keys: tuple[np.ndarray, ...], deepest: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of words under a model: the evidence, as far as it is held; of those that must be asked for, the deepest kind
    that is held, which is where the answer is at least (0 if none is held), and -1 for the others."""
    whole, first, size = keys
    of, floor, going = np.zeros(len(deepest)), np.where(deepest >= 0, 0, -1), np.flatnonzero(deepest >= 0)
    for kind, (known, e) in enumerate(held):
        going = going[deepest[going] >= kind]
        mine = going if kind == WHOLE else going[size[going] >= kind]
        if len(mine) and len(known):
            key = _key_of(kind, whole[mine], first[mine])
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            same = known[at] == key
            last = deepest[mine] == kind
            of[mine[same & last]], floor[mine[same & last]] = e[at[same & last]], -1
            floor[mine[same & ~last]] = kind
    return of, floor


def _sums(e: np.ndarray, times: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of words' evidence under a model, in order of rows: by row the sum over occurrences, that over words, and the
    three greatest from 0 on."""
    out = np.zeros((n, 5))
    out[:, 0], out[:, 1] = np.bincount(row, e * times, n), np.bincount(row, e, n)
    use = np.flatnonzero(e > 0)
    e, row = e[use], row[use]
    for k in range(3):
        if not len(row):
            break
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        most = np.maximum.reduceat(e, starts)
        out[row[starts], 2 + k] = most
        at = np.flatnonzero(e == np.repeat(most, np.diff(np.append(starts, len(row)))))
        at = at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]  # one of each row
        e, row = np.delete(e, at), np.delete(row, at)
    return out


_FOUND = "at long, key long, more long, model int, n long, different long, part array<double>, whole long, first long, size int, floor int, deepest int, times int"


def _found(shared, least: float):
    """Rows: at, key, more, model, text -> a row for each, with its numbers of words and of different words and the
    sums (part) of what is resolved here; and one for each of its different words that is not, with how often it has it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = shared.value
        types = [{"long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.list_(pa.float64())) for c in _FOUND.split(", ")]
        names = [c.split()[0] for c in _FOUND.split(", ")]

        def batch_of(length: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(length, t) for c, t in zip(names, types, strict=True)], names)

        for batch in batches:
            at, key, more, model = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            ids, times, n, known = [], [], [], {}
            for text in batch.column(4):
                counts = Counter(words_of(text.as_py()))
                ids.append(np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int64, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
                n.append((int(times[-1].sum()), len(counts)))
            if not known:
                continue
            keys, deepest = _deepest(list(known), bits)
            whole, first, size = keys
            for m in np.unique(model).tolist():
                rows = np.flatnonzero(model == m)
                word, count = np.concatenate([ids[r] for r in rows]), np.concatenate([times[r] for r in rows])
                row, numbers = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows]), np.array([n[r] for r in rows], np.int64)
                e, floor = _resolve(keys, deepest, held[m])
                e[np.abs(e) < least] = 0
                part = list(_sums(e[word], count, row, len(rows)))
                yield batch_of(len(rows), at=at[rows], key=key[rows], more=more[rows], model=model[rows], n=numbers[:, 0], different=numbers[:, 1], part=part)
                use = floor[word] >= 0
                row, word = row[use], word[use]
                columns = {"whole": whole.view(np.int64), "first": first.view(np.int64), "size": size, "floor": floor, "deepest": deepest}
                yield batch_of(len(row), at=at[rows][row], model=np.full(len(row), m), times=count[use], **{c: of_word[word] for c, of_word in columns.items()})

    return of


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and more (128 bits of hash of id and text), text as bytes."""
    hashes = F.xxhash64(id_col, text_col).alias("key"), F.xxhash64(F.lit("more"), text_col, id_col).alias("more")
    return docs.select(F.col(id_col).alias("id"), *hashes, F.col(text_col).cast("binary").alias("text"))


def measures(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Rows with key, more, text -> key, more, model, x (four measures), of texts with words; rows with a model are read
    with that one, others with all. Written."""
    if "model" not in rows.columns:
        rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, range(len(MODELS))))))
    with batches_of(rows.sparkSession, BATCH):
        return _measures(rows, known, least)


def _measures(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((_bitmap(known), _held(known)))
    # a row's number tells it from others with its id and text, and takes few bytes where its words are exchanged
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "key", "more", "model", "text")
    found = save(rows.mapInArrow(_found(held, least), _FOUND))
    words = found.where("whole is not null")
    different = words.select("whole", F.col("first").alias("own"), "size", "floor", "deepest").distinct()
    kinds = F.sequence("floor", F.greatest("floor", F.least("deepest", "size", F.lit(PREFIX))))
    kinds = F.explode(F.when(F.col("deepest") == WHOLE, F.concat(kinds, F.array(F.lit(WHOLE)))).otherwise(kinds)).alias("kind")
    asked = different.select("whole", "own", kinds)
    start = F.when(F.col("kind") == 0, 0).otherwise(_part(F.col("own"), F.greatest(F.lit(1), F.least("kind", F.lit(PREFIX)))))
    asked = asked.withColumn("first", start).withColumn("key", F.when(F.col("kind") == WHOLE, F.col("whole")).otherwise(F.col("first")))
    three = [f"e{m}" for m in range(len(MODELS))]
    last = asked.join(known.drop("seen"), ["kind", "key", "first"]).groupBy("whole", "own").agg(F.max_by(F.struct(*three), "kind").alias("e"))
    last = save(last.select("whole", F.col("own").alias("first"), "e.*").where(_clear(least)))
    words = attach(words.select("at", "model", "times", "whole", "first"), last, ["whole", "first"], limit=TABLE_BROADCAST)
    words = words.select("at", F.element_at(F.array(*three), F.col("model") + 1).alias("e"), "times").where(F.abs("e") >= least)
    parts = found.where("n > 0").select("at", "key", "more", "model", "n", "different", "part")
    both = parts.withColumns({"e": F.lit(None).cast("double"), "times": F.lit(None).cast("int")}).unionByName(words, allowMissingColumns=True)
    of_row = [*[F.max(c).alias(c) for c in parts.columns[1:]], F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "times"))).alias("words")]
    both = both.repartition("at").groupBy("at").agg(*of_row).withColumn("words", F.array_sort("words"))
    total = F.aggregate("words", F.get("part", F.lit(0)), lambda x, w: x + w.e * w.times) / F.col("n")
    each = F.aggregate("words", F.get("part", F.lit(1)), lambda x, w: x + w.e) / F.col("different")
    top = F.sort_array(F.concat(F.slice("part", 3, 3), F.transform("words", lambda w: F.greatest(w.e, F.lit(0.0)))), asc=False)
    three_greatest = (F.get(top, F.lit(0)) + F.get(top, F.lit(1)) + F.get(top, F.lit(2))) / 3
    x = both.select("key", "more", "model", F.array(F.get(top, F.lit(0)), three_greatest, total, each).alias("x"))
    x = save(x.groupBy("key", "more", "model").agg(F.max("x").alias("x")))  # rows with one id and text have the same
    discard(found, last)
    return x


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _curve(x: Column, curve: Logistic) -> Column:
    """The curve's score of a column of measures."""
    z = F.lit(float(curve.weight[-1]))
    for i in range(MEASURES):
        scaled = (F.get(x, i) - float(curve.centre[i])) / float(curve.scale[i])
        z = z + F.least(F.lit(8.0), F.greatest(F.lit(-8.0), scaled)) * float(curve.weight[i])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))))


def _none() -> Column:
    return F.array(*[F.lit(0.0)] * MEASURES)


def score(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", toxic_at: float = TOXIC_AT, least: float = LEAST, max_curve: int = MAX_CURVE
) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    rows = _keyed(docs, id_col, text_col)
    id_ = F.col(id_col)
    known = labels.where(F.col(label_col).isNotNull() & id_.isNotNull() & ~held_out(id_))
    known = save(known.groupBy(id_.alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y")))
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")
    learned = attach(rows.select("id", "text"), known, ["id"], "inner", LABELS_BROADCAST)
    words, nodes = counted(learned.select("text", (half * 2 + F.col("y")).alias("group")))
    table = evidence(words, nodes)
    discard(words, nodes)
    sample = save(known.orderBy(F.xxhash64(F.lit("curve"), F.col("id")), "id").limit(max_curve))
    curve_rows = rows.join(F.broadcast(sample), "id").select("id", "y", "key", "more", half.alias("model"), "text")
    found = measures(rows.select("key", "more", F.lit(ALL).alias("model"), "text").unionByName(curve_rows.drop("id", "y")), table, least)
    mine = save(curve_rows.drop("text").distinct())
    seen = mine.join(found, ["key", "more", "model"], "left").select("id", "y", F.coalesce("x", _none()).alias("x"))
    seen = seen.groupBy("id").agg(F.max("y").alias("y"), F.max("x").alias("x")).orderBy("id").toPandas()
    y = seen["y"].to_numpy(dtype=float)
    x = np.array(seen["x"].tolist(), float).reshape(len(y), MEASURES)
    curve = fit(x, y, ridge=1.0) if len(y) else fit(np.zeros((1, MEASURES)), np.zeros(1))
    all_ = found.where(F.col("model") == ALL).select("key", "more", "x")
    scored = rows.select("id", "key", "more", held_out(F.col("id")).alias("held_out")).join(all_, ["key", "more"], "left")
    scored = scored.select("id", "held_out", _curve(F.coalesce("x", _none()), curve).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_at).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
