"""What the operators share: word rules, the shared work folder, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwise.plans.tables import save

__all__ = ["WORD", "BROADCAST_ROWS", "attach", "batches_of", "n_words", "partitions", "row_key", "save", "table", "tidy_shuffles"]

#: A word is a run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest number of rows that `attach` broadcasts; its rows are narrow (keys and a few numbers).
BROADCAST_ROWS = 100_000


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table of few, narrow rows: broadcast if a count shows that it has at most
    `limit` rows; beyond that a sort-merge join, whose hot keys adaptive execution splits."""
    return big.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def partitions(spark: SparkSession) -> int:
    """Reducers of explicit repartitionings; the cluster's setting grows with its data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """What is written inside goes to workers in batches of that many rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy_shuffles(spark: SparkSession):
    """What is written inside leaves no shuffle files behind once it is written."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of hash of a row's id and text, as 32 digits."""
    halves = F.xxhash64(id_, text), F.xxhash64(F.lit("more"), text, id_)
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
