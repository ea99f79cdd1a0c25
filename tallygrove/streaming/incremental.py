"""Incremental processing: of each arriving batch, only the keys that a store lacks.

The batch form is one anti-join over the union of all windows; the streaming
form runs the same step on every micro-batch, so rows are worked on once
however often their source repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import read_or_none
from ..sources.writers import append


def missing(batch: DataFrame, store: str, key: str) -> DataFrame:
    """The batch's rows, one for each key, whose key the store doesn't have."""
    known = read_or_none(batch.sparkSession, store, [key])
    fresh = batch.dropDuplicates([key])
    return fresh if known is None else fresh.join(known, key, "left_anti")


def fill(batch: DataFrame, store: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Do ``work`` on what is missing and append its rows; a batch that is replayed finds its keys stored."""
    append(work(missing(batch, store, key)), store)


def keep_filled(stream: DataFrame, store: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False) -> StreamingQuery:
    """A query that fills the store from a stream; with ``once`` it stops when all that is there is done."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: fill(batch, store, key, work))
    return (writer.trigger(availableNow=True) if once else writer).start()
