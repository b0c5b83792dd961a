"""Optimistic transactions: conflict checks, first committer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Sequence numbers per block: no task holds more of one key's versions at once.
BLOCK = 1 << 16


def conflicts(history: DataFrame, checked: DataFrame) -> DataFrame:
    """Transactions ``tx_id`` and whether a version after their snapshot exists.

    ``checked`` has a row ``tx_id, key, read_seq, commit_seq`` for every written or
    locked key; a version with ``read_seq < seq <= commit_seq`` is a conflict,
    deletions included.  Values are not read.

    Such a version exists exactly if the newest one up to ``commit_seq`` is after
    ``read_seq``: a running maximum within blocks of sequence numbers, and the
    newest of the key's earlier blocks, so pairs of a hot key are never formed.
    """
    own = history.select("key", F.col("seq").alias("at"), F.col("seq").alias("_seq"))
    asked = checked.select("key", F.col("commit_seq").alias("at"), "tx_id", "read_seq", F.lit(True).alias("_asked"))
    rows = own.unionByName(asked, allowMissingColumns=True).filter("key is not null and at is not null").withColumn("_block", F.floor(F.col("at") / BLOCK))
    # at equal numbers the version comes first
    upto = Window.partitionBy("key", "_block").orderBy("at", F.col("_asked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("key", "_block").agg(F.max("_seq").alias("_top")).select("key", "_block", F.max("_top").over(past).alias("_earlier"))
    newest = rows.withColumn("_here", F.max("_seq").over(upto)).filter("_asked").join(earlier, ["key", "_block"])
    hit = newest.filter(F.coalesce("_here", "_earlier") > F.col("read_seq")).select("tx_id").distinct().withColumn("_hit", F.lit(1))
    return checked.select("tx_id").distinct().join(hit, "tx_id", "left").select("tx_id", F.coalesce("_hit", F.lit(0)).cast("long").alias("conflict"))


def group_verdicts(entries: DataFrame) -> DataFrame:
    """Verdicts within write groups, in ticket order: ``grp, ticket, accepted``.

    ``entries`` has ``grp, ticket, tx, writes, checks`` (``tx`` false for a plain
    write, which never fails; ``checks`` are the written and locked keys).  An
    entry fails if an earlier *accepted* one wrote a key it checks.  A group is
    bounded by the group byte limit, so its fold fits one row.
    """
    steps = F.array_sort(F.collect_list(F.struct("ticket", "tx", "writes", "checks")))

    def step(acc, x):
        ok = ~x["tx"] | ~F.arrays_overlap(acc["written"], x["checks"])
        return F.struct(
            F.when(ok, F.array_union(acc["written"], x["writes"])).otherwise(acc["written"]).alias("written"),
            F.array_append(acc["out"], F.struct(x["ticket"].alias("ticket"), ok.cast("long").alias("accepted"))).alias("out"),
        )

    kind = entries.schema["writes"].dataType.elementType.simpleString()
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("written"), F.array().cast("array<struct<ticket:bigint,accepted:bigint>>").alias("out"))
    return entries.groupBy("grp").agg(F.aggregate(steps, empty, step, lambda a: a["out"]).alias("_out")).select("grp", F.inline("_out"))
