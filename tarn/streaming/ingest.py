"""Continuous writes: a stream into a store, and hourly rollups of an append-only stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.sources.store import Store


def ingest(stream: DataFrame, store: Store, entity: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts every micro-batch and folds it into the rollups.

    The epoch is the batch's number within the stream, which its checkpoint names; so an epoch that runs again after a
    failure counts once, and direct writes and other streams have numbers of their own. Late records are accepted however
    late they are: their cell is addressed by their own date.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.write(entity, batch, batch=epoch, source=f"stream:{checkpoint}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_stream(stream: DataFrame, date: str, group: str, value: str) -> DataFrame:
    """Hourly count and sum for each group of a stream that only appends; for update mode. No watermark, which would drop
    late records."""
    cells = stream.groupBy(F.window(date, "1 hour").alias("w"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"))
    return cells.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("grp", F.col("w.start").alias("hour"), "n", "total")
