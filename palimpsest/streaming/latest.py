"""Latest state per key over a stream of versions, and ingestion into a store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import PUT
from palimpsest.shipping import ship


def latest(feed: DataFrame) -> DataFrame:
    """Newest version per key of a feed ``key, seq, kind, value`` (complete mode).

    The state is one row per key; order of arrival does not matter.
    """
    top = F.max_by(F.struct("kind", "value"), "seq")
    return feed.groupBy("key").agg(F.max("seq").alias("seq"), top.alias("_top")).select("key", "seq", "_top.kind", "_top.value")


def live(feed: DataFrame) -> DataFrame:
    """The put ones of :func:`latest`."""
    return latest(feed).filter(F.col("kind") == PUT).drop("kind")


def latest_updates(feed: DataFrame) -> DataFrame:
    """Changes of the newest version per key (update mode), keyed state on RocksDB.

    A version older than the one held changes nothing, so late or repeated rows
    are harmless.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("held", "seq long")

        def handleInputRows(self, key, rows, timers) -> Iterator:
            import pandas as pd

            best = None
            for pdf in rows:
                top = pdf.loc[pdf["seq"].idxmax()]
                if best is None or top["seq"] > best["seq"]:
                    best = top
            if best is not None and (not self.held.exists() or best["seq"] > self.held.get()[0]):
                self.held.update((int(best["seq"]),))
                yield pd.DataFrame({"key": [key[0]], "seq": [int(best["seq"])], "kind": [int(best["kind"])], "value": [best["value"]]})

        def close(self) -> None:
            pass

    ship(feed.sparkSession)
    ready = feed.select("key", "seq", F.col("kind").cast("int").alias("kind"), "value")
    return ready.groupBy("key").transformWithStateInPandas(Newest(), "key string, seq long, kind int, value string", "Update", "None")


def ingest(feed: DataFrame, store, checkpoint: str, **trigger):
    """Write a feed ``op_index, kind, key, value`` into a store, a commit per batch.

    The number of the batch is kept in the store under a reserved key in the same
    commit, so a batch that is run again after a failure is not applied twice.
    """
    mark = b"\x00stream:" + checkpoint.encode()

    def apply(batch: DataFrame, number: int) -> None:
        store.refresh()
        done = store.get(mark)
        if done is not None and int(done) >= number:
            return
        ops = batch.select(F.col("op_index").cast("long"), F.col("kind").cast("int").alias("kind"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        last = batch.sparkSession.createDataFrame([((1 << 62), PUT, bytearray(mark), bytearray(str(number).encode()))], "op_index long, kind int, key binary, value binary")
        store.write_frame(ops.unionByName(last))

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
