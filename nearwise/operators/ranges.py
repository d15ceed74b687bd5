"""Work along an order, split into ranges that tasks share: prefix sums and as-of joins.

Rows are dealt to ranges of the order and written with the number of their range, which rises with the order. What one
range hands to the next (its sums, its last value) is one row for each range and key, so nothing but those few
rows ever meets in one task, however many rows a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwise.plans.tables import save


def in_ranges(rows: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """The rows with `part`, the number of their range of `order`; written. Rows equal in all of it share a range."""
    n = ranges or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return save(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def prefix_sums(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """The rows with, by each of these names, the sum of its column over all rows before. `order` tells rows apart."""
    placed = in_ranges(rows.withColumns({f"{name}_of": c for name, c in sums.items()}), *order, ranges=ranges)
    totals = placed.groupBy("part").agg(*[F.sum(f"{name}_of").alias(f"{name}_up") for name in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("part", *[F.coalesce(F.sum(f"{name}_up").over(earlier), F.lit(0)).alias(f"{name}_up") for name in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = {name: F.coalesce(F.sum(f"{name}_of").over(own), F.lit(0)) + F.col(f"{name}_up") for name in sums}
    return placed.join(F.broadcast(totals), "part").withColumns(summed).select(*rows.columns, *sums)


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[tuple[str, str]] = (), *, order: Sequence[str] = (), forward: bool = False,
    strict: bool = False, within: Column | None = None, name: str = "match", ranges: int | None = None,
) -> DataFrame:
    """Every left row once, with `name`: the right row (a struct) of the same `by` (pairs of left and right columns) whose
    `right_on` is the last one up to `left_on`, or with `forward` the first one from it on; null if there is none.

    With `strict` equal values do not match. Right rows of one value are told apart by the columns `order`, of which
    the greatest is taken. `within` keeps matches for which it holds; it sees the left columns and `name`. Null keys
    and null values match nothing. A key's rows may fill many ranges: ranges are cut by value too, and a range's first
    rows take the last value of the key's ranges before."""
    if name in left.columns:
        raise ValueError(f"the left side has a column {name}")
    keys = [f"by{i}" for i in range(len(by))]
    row, match = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])
    tie = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    r = right.select(F.col(f"`{right_on}`").alias("t"), *[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, by, strict=True)], match.alias("match"), tie.alias("tie"), F.lit(0 if not strict else 1).alias("side"))
    r = r.dropna(subset=["t", *keys])
    l = left.select(F.col(f"`{left_on}`").alias("t"), *[F.col(f"`{c}`").alias(k) for k, (c, _) in zip(keys, by, strict=True)], row.alias("row"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in left.columns]).alias("spread"), F.lit(1 if not strict else 0).alias("side"))
    both = l.unionByName(r, allowMissingColumns=True)
    t = F.col("t").desc_nulls_first() if forward else F.col("t").asc_nulls_first()
    along = [t, F.col("side"), F.col("tie"), F.col("spread")]
    placed = in_ranges(both, *keys, *along, ranges=ranges)
    own = Window.partitionBy("part", *keys).orderBy(*along)
    placed = placed.withColumns({"own": F.last("match", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(own)})
    ends = placed.groupBy("part", *keys).agg(F.max_by("own", "at").alias("end"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("part", *keys, F.last("end", ignorenulls=True).over(before).alias("handed"))
    found = placed.where(F.col("row").isNotNull()).join(handed, ["part", *keys], "left")
    usable = F.col("t").isNotNull()
    found = found.select("row.*", F.when(usable, F.coalesce("own", "handed")).alias(name))
    return found if within is None else found.withColumn(name, F.when(within, F.col(name)))
