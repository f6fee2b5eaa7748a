"""Incremental keyed upsert of arriving batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldgauge.sources.log_store import LogStore
from fieldgauge.sources.store import VersionedStore


def newest_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key of a batch by ``order``. A batch may be one file that one task reads, and the fold sorts what it
    is given, so rows are dealt by key and order first; a hot key stays spread and folds before the exchange by key."""
    return batch.repartition(key, order).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")


def stream_upsert(stream: DataFrame, store: LogStore | VersionedStore, order: str, checkpoint: str,
                  first_version: int = 0) -> StreamingQuery:
    """Apply every micro-batch to the store under a version tied to its batch id,
    so a replayed batch rewrites its own version from the one before it and
    nothing counts twice. The order is kept and compared across batches."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply(newest_per_key(batch, store.key, order), version=first_version + batch_id, order=order)

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
