"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.staging import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATHS: list[str] = []


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    :func:`discard` and :func:`swept` remove what nothing reads any more.
    """
    spark = df.sparkSession
    _give_back()  # the driver's own training may have left much free memory behind
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _PATHS.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _PATHS.remove(path)


def discard(table: DataFrame) -> None:
    """Remove a table made by :func:`written` that no frame reads any more."""
    _remove(table.sparkSession, table.written_path)


@contextmanager
def swept(spark: SparkSession):
    """Removes, at its end, the tables written within, but those whose frames were
    appended to the list it gives."""
    first, keep = len(_PATHS), []
    try:
        yield keep
    finally:
        kept = {t.written_path for t in keep}
        for path in [p for p in _PATHS[first:] if p not in kept]:
            _remove(spark, path)


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (fold assignment)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def capped_share(counts: dict, cap: int, sizes: dict | None = None, size: int = 0) -> dict:
    """Share of each class to keep so that about ``cap`` rows of it are left, and
    about ``size`` bytes where ``sizes`` says how many it has."""
    return {k: min(1.0, cap / n, size / sizes[k] if sizes and sizes[k] else 1.0) for k, n in counts.items() if n}


def keep_share(shares: dict, key: Column, row_id: Column) -> Column:
    """Deterministic per-class thinning: hash of the row id under a threshold."""
    draw = F.pmod(F.xxhash64(row_id, F.lit("thin")), F.lit(1 << 30))
    test = F.lit(False)
    for k, share in shares.items():
        test = F.when(key == F.lit(k), draw < F.lit(int(share * (1 << 30)))).otherwise(test)
    return test


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Prepare for work in Python: workers get the code, and Arrow batches end by
    size too, as texts can be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def sliced(batches, rows: int = 256, text: int | None = None, size: int = 1 << 20):
    """Arrow batches cut into slices of at most ``rows`` rows.

    With ``text``, the place of a string column, a slice also ends once its strings
    have ``size`` bytes; a longer string is a slice of its own.
    """
    import numpy as np

    for batch in batches:
        if text is None:
            cuts = range(0, batch.num_rows, rows)
        else:
            import pyarrow.compute as pc

            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts, at = [], 0
            while at < batch.num_rows:
                cuts.append(at)
                before = ends[at - 1] if at else 0
                at = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(i, j - i)


_HELD: dict = {}


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def held(name: str | None = None, make=None):
    """This Python worker's object ``name``, made once; drops all other ones.

    Workers outlive tasks, so an object with a large memo serves many tasks of one
    operator, and is gone as soon as another operator runs in the worker.  Memory that
    earlier tasks freed goes back to the system.
    """
    for other in [k for k in _HELD if k != name]:
        del _HELD[other]
    _give_back()
    if name is not None and name not in _HELD:
        _HELD[name] = make()
    return _HELD.get(name)
