"""Work tables: written once to the folder that the cluster shares, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _temporary(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="nearwise-")


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may lack that setting, and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _temporary(spark.sparkContext.applicationId)


#: Folders of the scopes that are open, the innermost last.
_scopes: list[str] = []


def _home(spark: SparkSession) -> str:
    return f"{base_dir(spark)}/nearwise-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession) -> str:
    """A new folder for this application's work tables. When the application is over, its folder can go."""
    return "/".join([_home(spark), *_scopes, uuid.uuid4().hex])


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes this application's work tables. Results that were not written elsewhere cannot be read after it."""
    remove(spark, _home(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are deleted at the end: for results that are written elsewhere, as by micro-batches."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = "/".join([_home(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        remove(spark, folder)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more. Files that are no work tables are refused."""
    for df in tables:
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
        if strange := [f for f in folders if f"/nearwise-{df.sparkSession.sparkContext.applicationId}/" not in f]:
            raise ValueError(f"not a work table: {min(strange)}")
        for folder in folders:
            remove(df.sparkSession, folder)


def save(df: DataFrame, **options: str) -> DataFrame:
    """The rows, read from a written table: lineage ends here, and a lost executor costs only the reading
    again."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
