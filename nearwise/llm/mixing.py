"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a place in [0, 2^60): the first 60 bits of md5(seed:id). A source whose target is
b whole copies and a rest takes every document b times, and once more those below a threshold. The
threshold comes from a histogram of sizes over 4096 ranges of places; only the range in which the rest
runs out is looked at again, in ranges 4096 times finer, until each source has one place left there. Around
the threshold, among the places where about 64 documents of the source are expected on either side, the
one document whose taking or leaving brings the source nearest to its target is then turned. Nothing is
sorted but 4096 sums a source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id
hashes as the empty string; rows of one id share a place and are taken or left together (the side
nearer to the target); a table without words gets targets and takes of 0; an empty table gives no rows.
Columns beyond those named are passed on by `mix_documents` and ignored by `mix_counts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, n_words, save

PLACE_BITS, LEVEL_BITS, NEAR = 60, 12, 64


def place(id_: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the order of the sources with null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(key, source_size, rows) -> also weight, target: shares of the total by weight, none above cap times
    its source. Sources in order of cap * size / weight: those before the water level get their cap."""
    ordered, rising, whole = Window.orderBy("key"), Window.orderBy("ratio", "key"), Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    i = (F.row_number().over(ordered) - 1) % len(weights) + 1
    d = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), i).cast("long"))
    d = d.withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(whole))
    d = d.withColumn("ratio", F.col("most") / F.col("weight"))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    d = d.withColumn("capped", F.col("ratio") < level)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(whole)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(whole)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(left.cast("double") * F.col("weight") / free)
    return d.select("key", "source_size", "rows", "weight", target.alias("target"))


def _boundary(places: DataFrame, open_: DataFrame | None, plan: DataFrame, level: int) -> DataFrame:
    """For each source the range of this level in which its rest runs out: its prefix, what lies before
    it, its own size, and the places of its ends."""
    shift = PLACE_BITS - LEVEL_BITS * level
    if open_ is None:
        rows = places.withColumn("cum", F.lit(0).cast("long"))
    else:
        rows = places.withColumn("prefix", F.shiftright("place", shift + LEVEL_BITS))
        rows = attach(rows, open_.select("key", "prefix", "cum"), ["key", "prefix"])
    ranges = rows.groupBy("key", F.shiftright("place", shift).alias("prefix")).agg(
        F.sum("size").alias("own"), F.first("cum").alias("base"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    running = F.sum("own").over(Window.partitionBy("key").orderBy("prefix")) - F.col("own") + F.col("base")
    found = attach(ranges.withColumn("cum", running), plan.select("key", "rest"), ["key"])
    found = found.where((F.col("cum") < F.col("rest")) & (F.col("cum") + F.col("own") >= F.col("rest")))
    return found.select("key", "prefix", "cum", "own", "low", "high", "rest")


def mix_plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), cap=3, seed="mix") -> tuple[DataFrame, DataFrame]:
    """(places, plan): places has id, key, size and place of each document; plan has for each source
    key, source_size, target, copies (of every document), threshold (places below it: one more) and turned
    (the place for which that is the other way round, or null)."""
    places = save(
        docs.select(
            F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), n_words(F.col(text_col)).alias("size"), place(F.col(id_col), seed).alias("place")
        )
    )
    sizes = places.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = source_targets(sizes, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = save(plan.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    found, open_ = [], None
    for level in range(1, PLACE_BITS // LEVEL_BITS + 1):
        boundary = save(_boundary(places, open_, plan, level))
        single = F.col("low") == F.col("high")
        found.append(boundary.where(single))
        open_ = boundary.where(~single)
        if open_.isEmpty():
            break
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    take = F.when(F.col("rest") - F.col("cum") >= F.col("own") / 2, 1).otherwise(0)
    ends = ends.select("key", (F.col("low") + take).alias("threshold"), (F.col("rest") - (F.col("cum") + F.col("own") * take)).alias("short"))
    # a rest of 0 has no boundary
    plan = plan.join(ends, "key", "left").withColumns({"threshold": F.coalesce("threshold", F.lit(0).cast("long")), "short": F.coalesce("short", F.lit(0.0))})
    plan = save(plan)
    width = F.when(F.col("rows") <= NEAR, 1 << PLACE_BITS).otherwise(F.floor(F.lit(1 << PLACE_BITS) / F.col("rows")) * NEAR).cast("long")
    near = attach(places, plan.where("short <> 0").select("key", "threshold", "short", width.alias("width")), ["key"])
    near = near.where(F.abs(F.col("place") - F.col("threshold")) <= F.col("width")).groupBy("key", "place").agg(F.sum("size").alias("own"), F.first("threshold").alias("threshold"), F.first("short").alias("short"))
    left = F.abs(F.col("short") - F.when(F.col("place") >= F.col("threshold"), F.col("own")).otherwise(-F.col("own")))
    turned = near.withColumn("left", left).where(F.col("left") < F.abs("short")).groupBy("key").agg(F.min(F.struct("left", "place")).alias("best"))
    return places, save(plan.join(turned.select("key", F.col("best.place").alias("turned")), "key", "left"))


def _times() -> Column:
    more = (F.col("place") < F.col("threshold")) != F.coalesce(F.col("place") == F.col("turned"), F.lit(False))
    return F.col("copies") + F.when(more, 1).otherwise(0)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """id, size, source_size, target, times, taken for every row."""
    places, plan = mix_plan(docs, **options)
    rows = attach(places, plan, ["key"]).withColumn("times", _times())
    return rows.select("id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, id_col="doc_id", source_col="source", seed="mix", **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with its columns as they are."""
    _, plan = mix_plan(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(one, source_key(F.col(source_col)).alias("key"), place(F.col(id_col), seed).alias("place"))
    rows = attach(rows, plan.select("key", "copies", "threshold", "turned"), ["key"])
    rows = rows.where(_times() > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), _times())))
    return rows.select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    counts = mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY key),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::BIGINT AS weight,
         source_size * 3 AS most, (sum(source_size) OVER ())::BIGINT AS total FROM s),
r AS (SELECT *, most::DOUBLE / weight::DOUBLE AS ratio FROM w),
c AS (
  SELECT *, ratio < (total - coalesce(sum(most) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS capped FROM r),
t AS (
  SELECT key, source_size, n, CASE WHEN capped THEN most::DOUBLE ELSE
         (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::DOUBLE * weight::DOUBLE
         / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS copies FROM t),
q AS (SELECT *, target - copies * source_size AS rest FROM p),
u AS (SELECT key, place, sum(size)::BIGINT AS own FROM d GROUP BY key, place),
v AS (SELECT key, place, own, (sum(own) OVER (PARTITION BY key ORDER BY place))::BIGINT - own AS cum FROM u),
e AS (
  SELECT key, place + (rest - cum >= own / 2.0::DOUBLE)::BIGINT AS threshold, rest - (cum + own * (rest - cum >= own / 2.0::DOUBLE)::BIGINT) AS short
  FROM v JOIN q USING (key) WHERE cum < rest AND cum + own >= rest),
f AS (SELECT q.*, coalesce(threshold, 0) AS threshold, coalesce(short, 0) AS short FROM q LEFT JOIN e USING (key)),
z AS (
  SELECT f.key, u.place, abs(short - CASE WHEN u.place >= threshold THEN own ELSE -own END) AS remains
  FROM u JOIN f USING (key) WHERE short <> 0
  AND abs(u.place - threshold) <= CASE WHEN n <= 64 THEN 1152921504606846976 ELSE floor(1152921504606846976::DOUBLE / n)::BIGINT * 64 END
  AND abs(short - CASE WHEN u.place >= threshold THEN own ELSE -own END) < abs(short)),
t1 AS (SELECT key, arg_min(place, (remains, place)) AS turned FROM z GROUP BY key)
SELECT d.doc_id, d.size, f.source_size, f.target,
       (f.copies + CASE WHEN (d.place < f.threshold) <> coalesce(d.place = t1.turned, FALSE) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN f USING (key) LEFT JOIN t1 USING (key)
"""
