"""A stream of mutations into a store, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import KVStore


def ingest(stream: DataFrame, store: KVStore, name: str, checkpoint: str, order: str) -> StreamingQuery:
    """Rows (key, vtype, value, and `order` for those of one key) to the store, all that are there now.

    The manifest that publishes a micro-batch holds its number, so one that is tried again is not applied twice.
    """

    def apply(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            store.write_frame(rows, order, (name, batch_id))

    return stream.writeStream.queryName(name).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
