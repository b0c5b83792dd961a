"""Versions of keys: what is visible, what is newest, what may be dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import DELETE, PUT

#: Key ranges of files that are broadcast at most.
MOST_RANGES = 1 << 14
#: Snapshot bounds that one expression searches.
MOST_BOUNDS = 256


def newest(history: DataFrame, at: int | Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of every key at or below ``at``, deletions included.

    The bound comes before the choice: an older version counts where the newest
    one is above it.  The rank filter lets Spark keep one row per key and task
    before the shuffle, so a key with very many versions does no harm.  ``by`` names
    columns each of whose values is a history of its own, such as a write buffer.
    """
    rows = history if at is None else history.filter(F.col("seq") <= at)
    rank = F.row_number().over(Window.partitionBy(*by, "key").orderBy(F.desc("seq")))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def visible(history: DataFrame, at: int | Column | None = None) -> DataFrame:
    """Live pairs as of ``at``: the newest version of each key, if it is a put."""
    return newest(history, at).filter(F.col("kind") == PUT).drop("kind")


def newest_seq(history: DataFrame) -> DataFrame:
    """The newest sequence number of each key, deletions included; reads no values."""
    return history.groupBy("key").agg(F.max("seq").alias("seq"))


def visible_at_each(history: DataFrame, bounds: DataFrame) -> DataFrame:
    """Live pairs at every ``bound`` of a table of snapshot bounds.

    Each version belongs to the first bound that sees it; of a key's versions with
    the same first bound only the newest counts, which leaves the shuffle at most one
    row per key and bound and task.  A version is then repeated for the bounds up to
    the key's next one, which makes the result and no more.
    """
    marks = [r["bound"] for r in bounds.select("bound").filter("bound is not null").distinct().orderBy("bound").limit(MOST_BOUNDS + 1).collect()]
    if not marks:
        return history.select(F.lit(None).cast("long").alias("bound"), "key", "seq", "value").limit(0)
    if len(marks) > MOST_BOUNDS:  # too many to hold: in two halves of the sequence numbers
        middle = marks[MOST_BOUNDS // 2]
        return visible_at_each(history, bounds.filter(F.col("bound") <= middle)).unionByName(visible_at_each(history, bounds.filter(F.col("bound") > middle)))
    kind = dict(bounds.dtypes)["bound"]

    def first_at_least(low: int, high: int) -> Column:
        """Number of the first bound not below a version: a binary search as one expression."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("seq") <= F.lit(marks[middle]), first_at_least(low, middle)).otherwise(first_at_least(middle + 1, high))

    seen = newest(history.withColumn("_first", first_at_least(0, len(marks))).filter(F.col("_first") < len(marks)), by=("_first",))
    until = F.coalesce(F.lead("_first").over(Window.partitionBy("key").orderBy("_first")), F.lit(len(marks)))
    spans = seen.withColumn("_until", until).filter(F.col("kind") == PUT)
    table = F.array(*[F.lit(m).cast(kind) for m in marks])
    each = F.explode(F.slice(table, F.col("_first") + 1, F.col("_until") - F.col("_first")))
    return spans.withColumn("bound", each).drop("_first", "_until", "kind")


def with_newer(history: DataFrame) -> DataFrame:
    """Every version with ``newer``, the sequence number of the next newer one.

    The base is the immediately newer version, even one that is itself dropped.
    """
    return history.withColumn("newer", F.lag("seq").over(Window.partitionBy("key").orderBy(F.desc("seq"))))


def shadowed(history: DataFrame, oldest: int) -> DataFrame:
    """Versions no snapshot at or after ``oldest`` can see any more."""
    return with_newer(history).filter(F.col("newer") <= oldest)


def kept(history: DataFrame, oldest: int) -> DataFrame:
    """The complement of :func:`shadowed`: what a flush writes, deletions included."""
    return with_newer(history).filter(F.col("newer").isNull() | (F.col("newer") > oldest))


def compacted(history: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """What a merge writes: kept versions without deletions that hide nothing.

    An old deletion goes if no file of a deeper level has a key range covering its
    key.  ``deeper`` holds those files' ``smallest, largest``; None means the
    bottom level.  Their merged ranges are broadcast while they are few, and meet the
    old deletions by cells of the key space beyond that.
    """
    stay = kept(history, oldest).drop("newer")
    old_delete = (F.col("kind") == DELETE) & (F.col("seq") <= oldest)
    if deeper is None:
        return stay.filter(~old_delete)
    deleted = stay.filter(old_delete)
    if deeper.limit(MOST_RANGES + 1).count() <= MOST_RANGES:
        covered = deleted.join(F.broadcast(merged_ranges(deeper)), F.col("key").between(F.col("smallest"), F.col("largest")), "left_semi")
    else:
        from palimpsest.operators.files import holding

        ranges = deeper.select(F.lit(0).alias("id"), "smallest", "largest")
        covered = deleted.join(holding(ranges, deleted).select("key").distinct(), "key", "left_semi")
    return stay.filter(~old_delete).unionByName(covered)


def merged_ranges(files: DataFrame) -> DataFrame:
    """Key ranges of files merged where they overlap: at most one row per file."""
    before = Window.orderBy("smallest").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.max("largest").over(before) >= F.col("smallest"), 0).otherwise(1)
    run = Window.orderBy("smallest").rowsBetween(Window.unboundedPreceding, 0)
    return files.select("smallest", "largest").withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(run)).groupBy("_run").agg(
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest")
    ).drop("_run")


def oldest_snapshot(snapshots: DataFrame, last_seq: int) -> DataFrame:
    """One row ``oldest``: the least registered bound, capped by ``last_seq``."""
    return snapshots.filter("handles > 0").agg(F.least(F.coalesce(F.min("seq"), F.lit(last_seq)), F.lit(last_seq)).alias("oldest"))


def user_bytes(history: DataFrame) -> Column:
    """Key and value bytes of a version."""
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
