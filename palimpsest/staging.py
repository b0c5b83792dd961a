"""Frames that several consumers must see alike: written once to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from palimpsest.shipping import ship


@cache
def _own_dir() -> str:
    """A folder of this process that goes with it."""
    made = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, as in tests, a local master gets a folder of its own:
    driver and executors are one process there.  On a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: its rows and their partitions no longer change.

    Range partitions are drawn anew each time a plan runs, so whatever counts rows by
    partition and then uses the counts needs this in between.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def in_order(df: DataFrame) -> Iterator[tuple]:
    """The rows of a sorted frame as tuples on the driver, which holds a partition at a time.

    They come as Arrow streams of some thousand rows: rows one by one take several times
    as long.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    import pyarrow as pa

    ship(df.sparkSession)
    for r in df.mapInArrow(run, "rows binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(r["rows"]):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
