"""Point, multi-point, range, pattern and paged reads of live pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidArgument
from palimpsest.functions.glob import like
from palimpsest.operators.history import visible
from palimpsest.shipping import ship
from palimpsest.staging import settled


def in_range(key: Column, low=None, high=None, low_open: bool = False, high_open: bool = True) -> Column:
    """A key range; ``None`` is no bound.  Contradicting bounds hold nothing."""
    test = F.lit(True)
    if low is not None:
        test = (key > F.lit(low)) if low_open else (key >= F.lit(low))
    if high is not None:
        upper = (key < F.lit(high)) if high_open else (key <= F.lit(high))
        test = upper if low is None else test & upper
    return test


def scan(history: DataFrame, low=None, high=None, low_open: bool = False, high_open: bool = True, at: int | None = None) -> DataFrame:
    """Live pairs of a key range as of ``at``.

    The range is applied below the choice of versions, where it reaches the scan.
    """
    return visible(history.filter(in_range(F.col("key"), low, high, low_open, high_open)), at)


def prefix_scan(history: DataFrame, prefix: str, at: int | None = None) -> DataFrame:
    """Live pairs whose key starts with ``prefix``."""
    return visible(history.filter(F.col("key").startswith(prefix)), at)


def get(history: DataFrame, keys: list, at: int | None = None) -> DataFrame:
    """Live pairs among the given keys."""
    return visible(history.filter(F.col("key").isin(keys)), at)


def multi_get(history: DataFrame, wanted: DataFrame, at: int | None = None) -> DataFrame:
    """For every row ``pos, key`` of ``wanted`` its value or null, all at one bound.

    Only the wanted keys' versions go through the version choice.
    """
    keys = wanted.select("key").distinct()
    return wanted.join(visible(history.join(keys, "key", "left_semi"), at).select("key", "value"), "key", "left").select("pos", "key", "value")


def exists_count(history: DataFrame, wanted: DataFrame, at: int | None = None) -> DataFrame:
    """How many of the wanted rows have a value; repeated keys count again."""
    keys = wanted.select("key").distinct()
    live = visible(history.select("key", "seq", "kind").join(keys, "key", "left_semi"), at).select("key")
    return wanted.join(live, "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def count_keys(history: DataFrame, at: int | None = None) -> DataFrame:
    """The number of live keys; reads no values."""
    return visible(history.select("key", "seq", "kind"), at).agg(F.count(F.lit(1)).alias("n"))


def keys_like(history: DataFrame, pattern: bytes | str, at: int | None = None) -> DataFrame:
    """Live keys that match a glob; the glob is applied below the version choice."""
    return visible(history.select("key", "seq", "kind").filter(like(F.col("key"), pattern)), at).select("key")


def first_pairs(history: DataFrame, low, high, limit: int, at: int | None = None) -> DataFrame:
    """The first ``limit`` pairs of a half-open range with their position."""
    if limit < 0:
        raise InvalidArgument("LIMIT must be a non-negative integer")
    few = scan(history, low, high, at=at).orderBy("key").limit(limit)  # bounded by the limit from here on
    return few.withColumn("pos", F.row_number().over(Window.orderBy("key")).cast("long"))


def page(history: DataFrame, cursor: int, count: int = 10, pattern: bytes | str = b"*", at: int | None = None) -> DataFrame:
    """One page of keys: ``pos, key, next_cursor``.

    ``count`` keys after the first ``cursor`` are examined and filtered by the
    pattern afterwards, so a page may be short or empty; a next cursor of 0 means
    the end.  Like the walk it stands for, a page costs its cursor: each task
    keeps at most ``cursor + count + 1`` keys.
    """
    if cursor < 0:
        raise InvalidArgument("invalid cursor")
    if count <= 0:
        raise InvalidArgument("value is not an integer or out of range")
    keys = visible(history.select("key", "seq", "kind"), at).select("key").orderBy("key").limit(cursor + count + 1)
    ranked = keys.withColumn("pos", F.row_number().over(Window.orderBy("key")).cast("long"))
    more = F.max("pos").over(Window.partitionBy()) > cursor + count
    paged = ranked.withColumn("next_cursor", F.when(more, F.lit(cursor + count)).otherwise(F.lit(0)).cast("long"))
    return paged.filter((F.col("pos") > cursor) & (F.col("pos") <= cursor + count)).filter(like(F.col("key"), pattern)).select("pos", "key", "next_cursor")


def seek_next(live: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """For every distinct ``start`` the next ``n`` live keys: ``start, key, rn``.

    ``live`` has distinct keys, ``starts`` any number of rows.  Keys and starts are
    range-partitioned and sorted together, and one pass over each partition hands
    every start the keys behind it.  A start near the end of its partition takes the
    rest from what comes after, for which each partition tells its first ``n`` keys.
    One shuffle of keys and starts, no pairs beyond the result.  Null starts and keys
    take no part; a start behind the last key has no rows.
    """
    if n < 0:
        raise InvalidArgument("LIMIT must be a non-negative integer")
    kind = dict(live.dtypes)["key"]
    keys = live.select("key", F.lit(1).cast("byte").alias("_kind")).filter("key is not null")
    asked = starts.select(F.col("start").cast(kind).alias("key")).filter("key is not null").distinct().withColumn("_kind", F.lit(0).cast("byte"))
    rows = settled(keys.unionByName(asked).repartitionByRange("key").sortWithinPartitions("key", "_kind"))

    def run(batches, edges: bool):
        """The starts' keys, or what they lack and the first keys of the partition."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, text = TaskContext.get().partitionId(), pa.binary() if kind == "binary" else pa.string()
        head, waiting, lacking = 0, pa.array([], text), np.zeros(0, np.int64)

        def out(what, start, key, rn):
            size = len(rn)
            cols = [pa.array(np.full(size, part, np.int32)), pa.array(np.full(size, what, np.int8)), start, key, pa.array(np.asarray(rn, np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["part", "what", "start", "key", "rn"])

        for batch in batches:
            is_key = batch.column(1).to_numpy(zero_copy_only=False) == 1
            here = batch.column(0).filter(pa.array(is_key)).cast(text)
            own = batch.column(0).filter(pa.array(~is_key)).cast(text)
            if edges and head < n and len(here):
                more = here.slice(0, n - head)
                yield out(HEAD, pa.nulls(len(more), text), more, np.arange(head, head + len(more)))
                head += len(more)
            # keys before each start of this batch, and 0 for those that still wait
            at = np.concatenate([np.zeros(len(waiting), np.int64), np.cumsum(is_key)[~is_key]])
            had = np.concatenate([n - lacking, np.zeros(len(own), np.int64)])
            everyone = pa.concat_arrays([waiting, own])
            take = np.minimum(n - had, len(here) - at)
            for k in range(0, 0 if edges else len(take), 4096):  # slices bound the rows made at once
                part_take = take[k : k + 4096]
                which = np.repeat(np.arange(k, k + len(part_take)), part_take)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(part_take) - part_take, part_take)
                if len(which):
                    yield out(HIT, everyone.take(pa.array(which)), here.take(pa.array(at[which] + inside)), had[which] + inside + 1)
            still = n - had - take
            waiting, lacking = everyone.filter(pa.array(still > 0)), still[still > 0]
        if edges and len(waiting):
            yield out(OPEN, waiting, pa.nulls(len(waiting), text), n - lacking)

    ship(live.sparkSession)
    shape = f"part int, what byte, start {kind}, key {kind}, rn long"
    hits = rows.mapInArrow(lambda batches: run(batches, False), shape).select("start", "key", "rn")
    found = settled(rows.mapInArrow(lambda batches: run(batches, True), shape))
    # first keys of all partitions in order: at most n a partition
    heads = found.filter(F.col("what") == HEAD).select("part", "key", "rn").withColumn("place", F.row_number().over(Window.orderBy("part", "rn")))
    before = found.select("part").distinct().join(heads.groupBy("part").agg(F.count(F.lit(1)).alias("own")), "part", "left")
    upto = before.select("part", F.sum(F.coalesce("own", F.lit(0))).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("base"))
    left = found.filter(F.col("what") == OPEN).select("part", "start", F.col("rn").alias("had")).join(upto, "part")
    wanted = left.select("start", F.posexplode(F.sequence(F.col("had") + 1, F.lit(n).cast("long"))).alias("step", "rn"), "base").withColumn("place", F.col("base") + F.col("step") + 1)
    return hits.unionByName(wanted.join(heads.select("place", "key"), "place").select("start", "key", "rn"))


#: Rows a partition of :func:`seek_next` gives: found, still lacking keys, first keys.
HIT, OPEN, HEAD = 0, 1, 2
