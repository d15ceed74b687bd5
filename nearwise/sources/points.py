"""Points from and to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_points(lines: DataFrame, *, text_col: str = "value", strict: bool = False, whole: bool = True) -> DataFrame:
    """Lines `x y[,x y...]` -> x, y of the first pair, and its text as user_data. Every pair must be two
    numbers; other lines are left out, or raise an error if `strict`. Coordinates are cut to whole numbers
    unless `whole` is False. Null lines are left out either way."""
    pairs = F.split(F.col(text_col), ",")
    number = lambda p, i: F.try_element_at(F.split(p, " "), F.lit(i)).try_cast("double")
    fine = F.forall(pairs, lambda p: F.coalesce((F.size(F.split(p, " ")) == 2) & number(p, 1).isNotNull() & number(p, 2).isNotNull(), F.lit(False)))
    first = F.get(pairs, 0)
    cut = (lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")) if whole else (lambda v: v)
    rows = lines.where(F.col(text_col).isNotNull())
    if strict:
        bad = F.raise_error(F.concat(F.lit("not points: "), F.col(text_col))).cast("double")
        return rows.select(*[F.when(fine, cut(number(first, i))).otherwise(bad).alias(c) for i, c in ((1, "x"), (2, "y"))], first.alias("user_data"))
    return rows.where(fine).select(cut(number(first, 1)).alias("x"), cut(number(first, 2)).alias("y"), first.alias("user_data"))


def read_points(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_points(spark.read.text(path), **options)


def format_results(joined: DataFrame, left_text: Column, *, text_of=lambda n: n.id.cast("string")) -> DataFrame:
    """value: `left text;distance,right text;...` in the order of `neighbors`, eight decimals."""
    parts = F.transform("neighbors", lambda n: F.concat(F.format_string("%.8f", n.distance), F.lit(","), F.coalesce(text_of(n), F.lit(""))))
    return joined.select(F.array_join(F.concat(F.array(F.coalesce(left_text.cast("string"), F.lit(""))), parts), ";").alias("value"))


def write_results(formatted: DataFrame, path: str) -> None:
    formatted.write.option("compression", "gzip").text(path)
