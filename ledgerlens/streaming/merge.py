"""Continuous imports: micro-batches of a stream merged into a keyed table.

An addition of this engine: a keyed recipe's import, with a stream in place of the recipe's rerun. A batch that is
delivered again merges to the same table, so a restart from the checkpoint loses and doubles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(batch: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by ``order``; without it a key may occur once only."""
    if order is None:
        return batch
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*batch.columns))
    return batch.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def start(ws, dataset: str, table: str, stream: DataFrame, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Merges each micro-batch of ``stream`` into a table whose recipe names a key; every batch is one snapshot."""

    def merge(batch: DataFrame, _: int) -> None:
        ws.merge(dataset, table, batch, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, time: str, keys: list[str], values: list[str], late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts and sums by key and time window, of a stream or a table; rows later than ``late`` are left out of a stream."""
    return (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"sum_{v}") for v in values]).select(F.col("w.start").alias("window_start"), *keys, "n", *[f"sum_{v}" for v in values])

