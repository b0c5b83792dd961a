"""Key filters of files and cache behaviour, as measured over batches."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import bloom
from palimpsest.operators.writes import greedy_cuts
from palimpsest.shipping import ship


def build_filters(entries: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """One encoded filter per file of ``id, key``: ``id, keys, filter``.

    Distinct keys come first, so a file's versions are reduced before they meet.
    A file has a bounded size, and with it the group that builds its filter.
    """

    def run(key, pdf):
        import pandas as pd

        keys = [k.encode() if isinstance(k, str) else bytes(k) for k in pdf["key"]]
        return pd.DataFrame({"id": [key[0]], "keys": [len(keys)], "filter": [bloom.build(keys, bits_per_key)]})

    ship(entries.sparkSession)
    return entries.select("id", "key").distinct().groupBy("id").applyInPandas(run, "id long, keys long, filter binary")


def probe_filters(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether each probe ``id, key`` may be in its file: ``id, key, maybe``."""

    def run(key, left, right):
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "key": [], "maybe": []})
        keys = list(right["key"])
        hit = bloom.test(bytes(left["filter"].iloc[0]), [k.encode() if isinstance(k, str) else bytes(k) for k in keys])
        return pd.DataFrame({"id": [key[0]] * len(keys), "key": keys, "maybe": hit})

    ship(probes.sparkSession)
    kind = dict(probes.dtypes)["key"]
    return filters.groupBy("id").cogroup(probes.select("id", "key").groupBy("id")).applyInPandas(run, f"id long, key {kind}, maybe boolean")


def cache_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """Hits of a byte-bounded least-recently-used cache over each queue's accesses.

    ``accesses`` has ``queue, ticket, block, bytes``.  An item larger than the
    capacity is never held; a capacity of 0 turns the cache off.  A queue is one
    cache, whose state is its whole content, so its accesses pass one task in order;
    memory holds the cached items and a batch.
    """

    def run(batches):
        import pyarrow as pa

        at, held, used = None, OrderedDict(), 0
        for batch in batches:
            hits = []
            for queue, block, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if queue != at:
                    at, held, used = queue, OrderedDict(), 0
                hit = block in held
                hits.append(int(hit))
                if hit:
                    held.move_to_end(block)
                elif size <= capacity:
                    held[block] = size
                    used += size
                    while used > capacity:
                        used -= held.popitem(last=False)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hits, pa.int64())], names=["queue", "ticket", "block", "hit"])

    ship(accesses.sparkSession)
    rows = accesses.select(*(F.col(c).cast("long") for c in ("queue", "ticket", "block", "bytes")))
    return rows.repartition("queue").sortWithinPartitions("queue", "ticket").mapInArrow(run, "queue long, ticket long, block long, hit long")


def memtable_switches(entries: DataFrame, limit: int) -> DataFrame:
    """Write buffer of every version ``queue, seq, bytes``: a full one is switched.

    The buffer's size counts all versions; the version that fills it is its last.
    """
    return greedy_cuts(entries, "seq", "buffer", limit, ends_full=True)
