"""Version histories derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(user: Column) -> Column:
    return F.concat(F.lit("user:"), F.lpad(user.cast("string"), 6, "0"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a version of its user; an error deletes."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return e.select(
        user_key(F.col("user_id")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, 2).otherwise(1).alias("kind"),
        F.when(~error, F.concat(F.col("event_type"), F.lit(":"), cents)).alias("value"),
    )


#: The same history, live pairs, and one "file" per 250 sequence numbers.
SQL = """
h as (select concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as k, event_id + 1 as seq,
             case when event_type = 'error' then 'D' else 'P' end as kind,
             case when event_type = 'error' then null
                  else concat(event_type, ':', cast(cast(round(value*100) as bigint) as varchar(20))) end as v
      from events),
live as (select k, seq, v from (select *, row_number() over (partition by k order by seq desc) rn from h) t
         where rn = 1 and kind = 'P'),
tb as (select cast(floor((seq-1)/250) as bigint) as id, min(k) as smallest, max(k) as largest, count(*) as entries
       from h group by cast(floor((seq-1)/250) as bigint)),
ob as (select cast(floor((o_orderkey-1)/1000) as bigint) as id, lpad(cast(o_orderkey as varchar(20)), 10, '0') as k from orders),
ot as (select id, min(k) as smallest, max(k) as largest, count(*) as entries, count(*) * 64 as n_bytes from ob group by id)
"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 250 sequence numbers each; nearly all overlap."""
    from palimpsest.operators.files import file_stats

    return file_stats(history(spark, sf_dir).withColumn("id", F.floor((F.col("seq") - 1) / 250)))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential load: files of 1000 order keys each, all disjoint."""
    o = table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    rows = o.select(F.floor((F.col("o_orderkey") - 1) / 1000).alias("id"), key.alias("key"), F.col("o_orderkey").alias("seq"))
    from palimpsest.operators.files import file_stats

    return file_stats(rows).withColumn("file_size", F.col("entry_count") * 64)
