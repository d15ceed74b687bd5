"""Neighbours of points that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from nearwise.operators.join import knn_join
from nearwise.operators.stored import Stored
from nearwise.plans.tables import scratch


def stream_knn(stream: DataFrame, right: DataFrame | str, k: int, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """Each micro-batch of left rows is joined with `right` and handed to `sink` with its number, which writes it. `right` is a
    table, laid out anew for each batch, or the folder of a stored index, which is opened as it is at the time of the
    batch. Ranks are no streaming operation, and a batch's neighbours depend on no other batch, so nothing is kept
    between them: a batch's work tables are deleted when `sink` returns."""

    def joined(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            fixed = Stored.open(spark, right).index() if isinstance(right, str) else right
            sink(knn_join(batch, fixed, k, **options), number)

    return stream.writeStream.foreachBatch(joined)
