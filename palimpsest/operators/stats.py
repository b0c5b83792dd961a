"""Measures over histories, commits and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_amplification(moved: DataFrame) -> DataFrame:
    """One row from ``kind, n_bytes`` with kinds user, flush and compaction."""
    total = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_bytes"))), F.lit(0)).cast("long") for k in ("user", "flush", "compaction")}
    sums = moved.agg(*[c.alias(k + "_bytes") for k, c in total.items()])
    ratio = F.when(F.col("user_bytes") > 0, (F.col("flush_bytes") + F.col("compaction_bytes")) / F.col("user_bytes")).otherwise(F.lit(0.0))
    return sums.withColumn("write_amp", ratio)


def percentiles(values: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at index ``floor(n * p)``, capped.

    Equal values are counted first, so what is ranked is one row per distinct
    value, and a hot value is one row.
    """
    keys = by or []
    counted = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda p: F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    picks = [F.min(F.when(F.col("_upto") > at(p), F.col(column))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*keys).agg(*picks) if keys else ranked.agg(*picks)


def store_counts(history: DataFrame) -> DataFrame:
    """Versions, live keys, deletions and bytes of a history in one pass over keys."""
    from palimpsest.operators.history import user_bytes

    per_key = history.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == 2).alias("deletes"), F.sum(user_bytes(history)).alias("bytes"),
        F.max("seq").alias("last"), F.max_by("kind", "seq").alias("last_kind"),
    )
    return per_key.agg(
        F.sum("n").alias("versions"), F.count(F.lit(1)).alias("keys_seen"), F.count_if(F.col("last_kind") == 1).alias("live_keys"),
        F.sum("deletes").alias("deletions"), F.sum("bytes").cast("long").alias("user_bytes"), F.max("last").alias("last_sequence"),
    )
