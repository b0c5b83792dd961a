"""One query per operator, with SQL over the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import files, filters, history as hist, reads, stats, transactions, writes
from palimpsest.staging import shared_dir
from palimpsest.plans.inputs import SQL, event_files, history, order_files, table, user_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SOME_KEYS = ["user:000046", "user:000003", "user:000017"]
WANTED = ["user:000003", "user:000046", "user:999999", "user:000003", "user:000120"]
LOW, HIGH = "user:000020", "user:000040"
AS_OF = 5000


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"with recursive {SQL}" if "--recursive" in sql else f"with {SQL}"
            ORACLES[f.__name__] = (head + sql.replace("--recursive", "")) if not sql.lstrip().startswith("select_only") else sql.replace("select_only", "", 1)
        return f

    return keep


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, w) for k, w in enumerate(WANTED)], "pos long, key string")


_WANTED_SQL = "(values " + ", ".join(f"({k + 1}, '{w}')" for k, w in enumerate(WANTED)) + ") w(pos, k)"


def _kv(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").alias("k"), *more, F.col("value").alias("v"))


# -- point and multi-point reads ------------------------------------------------


@query(" select k, seq, v from live")
def scan_latest(spark, sf_dir):
    return _kv(hist.visible(history(spark, sf_dir)), "seq")


@query(f" select k, v from live where k in ({', '.join(repr(k) for k in SOME_KEYS)})")
def get_point(spark, sf_dir):
    return _kv(reads.get(history(spark, sf_dir), SOME_KEYS))


_AS_OF = f"""select k, seq, v from (select *, row_number() over (partition by k order by seq desc) rn from h where seq <= {AS_OF}) t
where rn = 1 and kind = 'P'"""


@query(f" select k, v from ({_AS_OF}) s where k in ({', '.join(repr(k) for k in SOME_KEYS)})")
def get_asof(spark, sf_dir):
    return _kv(reads.get(history(spark, sf_dir), SOME_KEYS, AS_OF))


@query(" " + _AS_OF)
def scan_asof(spark, sf_dir):
    return _kv(hist.visible(history(spark, sf_dir), AS_OF), "seq")


@query("""
, b(bound) as (values (100), (500), (2500), (5000))
select bound, k, seq, v from (select b.bound, h.*, row_number() over (partition by b.bound, k order by seq desc) rn from h join b on h.seq <= b.bound) t
where rn = 1 and kind = 'P'""")
def scan_at_snapshots(spark, sf_dir):
    bounds = spark.createDataFrame([(100,), (500,), (2500,), (5000,)], "bound int")
    return hist.visible_at_each(history(spark, sf_dir), bounds).select("bound", F.col("key").alias("k"), "seq", F.col("value").alias("v"))


@query(" select k, max(seq) as seq from h group by k")
def newest_seq(spark, sf_dir):
    return hist.newest_seq(history(spark, sf_dir)).withColumnRenamed("key", "k")


@query(" select k, seq, kind from (select *, row_number() over (partition by k order by seq desc) rn from h) t where rn = 1")
def newest_version(spark, sf_dir):
    return hist.newest(history(spark, sf_dir)).select(F.col("key").alias("k"), "seq", F.when(F.col("kind") == 1, "P").otherwise("D").alias("kind"))


@query(f" select cast(w.pos as bigint) as pos, w.k, live.v from {_WANTED_SQL} left join live on live.k = w.k")
def mget(spark, sf_dir):
    return reads.multi_get(history(spark, sf_dir), _wanted(spark)).select("pos", F.col("key").alias("k"), F.col("value").alias("v"))


@query(f" select count(*) as n from {_WANTED_SQL} join live on live.k = w.k")
def exists_count(spark, sf_dir):
    return reads.exists_count(history(spark, sf_dir), _wanted(spark))


# -- ranges -----------------------------------------------------------------------

for _name, _args, _sql in (
    ("scan_incl_excl", dict(low=LOW, high=HIGH), f"k >= '{LOW}' and k < '{HIGH}'"),
    ("scan_incl_incl", dict(low=LOW, high=HIGH, high_open=False), f"k >= '{LOW}' and k <= '{HIGH}'"),
    ("scan_excl_incl", dict(low=LOW, high=HIGH, low_open=True, high_open=False), f"k > '{LOW}' and k <= '{HIGH}'"),
    ("scan_from", dict(low=HIGH), f"k >= '{HIGH}'"),
    ("scan_to", dict(high=LOW), f"k < '{LOW}'"),
    ("scan_empty", dict(low=LOW, high=LOW), f"k >= '{LOW}' and k < '{LOW}'"),
    ("scan_reversed_bounds", dict(low=HIGH, high=LOW), f"k >= '{HIGH}' and k < '{LOW}'"),
):
    QUERIES[_name] = lambda spark, sf_dir, args=_args: _kv(reads.scan(history(spark, sf_dir), **args))
    ORACLES[_name] = f"with {SQL} select k, v from live where {_sql}"


@query(" select k, v from live where k like 'user:00001%'")
def prefix_scan(spark, sf_dir):
    return _kv(reads.prefix_scan(history(spark, sf_dir), "user:00001"))


@query(" select count(*) as n from live")
def dbsize(spark, sf_dir):
    return reads.count_keys(history(spark, sf_dir))


@query(" select k from live where k like 'user:0%1_'")
def keys_glob(spark, sf_dir):
    return reads.keys_like(history(spark, sf_dir), "user:0*1?").withColumnRenamed("key", "k")


@query("""
, r as (select k, row_number() over (order by k) as pos, count(*) over () as n from live)
select pos, k, cast(case when n > 50 then 50 else 0 end as bigint) as next_cursor from r where pos > 20 and pos <= 50 and k like '%2%'""")
def scan_page(spark, sf_dir):
    return reads.page(history(spark, sf_dir), 20, 30, "*2*").select("pos", F.col("key").alias("k"), "next_cursor")


@query(f" select pos, k, v from (select k, v, row_number() over (order by k) as pos from live where k >= '{LOW}' and k < 'user:000090') t where pos <= 25")
def range_limit(spark, sf_dir):
    return _kv(reads.first_pairs(history(spark, sf_dir), LOW, "user:000090", 25), "pos")


@query("""
, st as (select distinct concat('user:', lpad(cast(o_custkey % 400 as varchar(20)), 6, '0'), case when o_orderkey % 3 = 0 then 'x' else '' end) as s from orders)
select s, k, rn from (select st.s, live.k, row_number() over (partition by st.s order by live.k) as rn from st join live on live.k >= st.s) t where rn <= 10""")
def seek_next(spark, sf_dir):
    live = hist.visible(history(spark, sf_dir).select("key", "seq", "kind"))
    o = table(spark, sf_dir, "orders")
    starts = o.select(F.concat(user_key(F.col("o_custkey") % 400), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("")).alias("start"))
    return reads.seek_next(live, starts, 10).select(F.col("start").alias("s"), F.col("key").alias("k"), "rn")


@query("""
, w as (select o_orderkey as pos, concat('user:', lpad(cast(o_custkey as varchar(20)), 6, '0')) as k from orders)
select w.pos, w.k, live.v from w left join live on live.k = w.k""")
def mget_many(spark, sf_dir):
    """One wanted key per order, repeated and missing ones included, as one join."""
    o = table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_orderkey").alias("pos"), user_key(F.col("o_custkey")).alias("key"))
    return reads.multi_get(history(spark, sf_dir), wanted).select("pos", F.col("key").alias("k"), F.col("value").alias("v"))


# -- garbage collection -------------------------------------------------------------

_NEWER = "(select *, lag(seq) over (partition by k order by seq desc) as newer from h) t"


def _kind(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("k"), "seq", F.when(F.col("kind") == 1, "P").otherwise("D").alias("kind"))


@query(f" select k, seq from {_NEWER} where newer <= {AS_OF}")
def gc_shadowed(spark, sf_dir):
    return hist.shadowed(history(spark, sf_dir), AS_OF).select(F.col("key").alias("k"), "seq")


@query(f" select k, seq, kind from {_NEWER} where newer is null or newer > {AS_OF}")
def gc_kept(spark, sf_dir):
    return _kind(hist.kept(history(spark, sf_dir), AS_OF))


@query(f" select k, seq, kind from {_NEWER} where (newer is null or newer > {AS_OF}) and not (kind = 'D' and seq <= {AS_OF})")
def gc_tombstones(spark, sf_dir):
    return _kind(hist.compacted(history(spark, sf_dir), AS_OF))


@query(f"""
, deep(smallest, largest) as (values ('user:000010', 'user:000050'), ('user:000040', 'user:000060'), ('user:000110', 'user:000120'))
select k, seq, kind from {_NEWER} where (newer is null or newer > {AS_OF})
and not (kind = 'D' and seq <= {AS_OF} and not exists (select 1 from deep where t.k between deep.smallest and deep.largest))""")
def gc_tombstones_ranges(spark, sf_dir):
    deep = spark.createDataFrame([("user:000010", "user:000050"), ("user:000040", "user:000060"), ("user:000110", "user:000120")], "smallest string, largest string")
    return _kind(hist.compacted(history(spark, sf_dir), AS_OF, deep))


@query("""
select batch, k, seq, kind from (select *, cast(floor((seq-1)/250) as bigint) as batch,
  row_number() over (partition by cast(floor((seq-1)/250) as bigint), k order by seq desc) rn from h) t where rn = 1""")
def flush_dedup(spark, sf_dir):
    h = history(spark, sf_dir).withColumn("batch", F.floor((F.col("seq") - 1) / 250))
    return hist.newest(h, by=("batch",)).select("batch", F.col("key").alias("k"), "seq", F.when(F.col("kind") == 1, "P").otherwise("D").alias("kind"))


@query("""
, s(seq, handles) as (values (700, 1), (400, 0), (900, 2))
select least(coalesce(min(seq), 800), 800) as oldest from s where handles > 0""")
def oldest_snapshot(spark, sf_dir):
    return hist.oldest_snapshot(spark.createDataFrame([(700, 1), (400, 0), (900, 2)], "seq int, handles int"), 800)


# -- batches, counters, sequence numbers ---------------------------------------------

_BATCH_SQL = """
, w as (select k, kind, v from (select concat('user:', lpad(cast(o_custkey % 200 as varchar(20)), 6, '0')) as k,
    case when o_orderkey % 5 = 0 then 'D' else 'P' end as kind,
    case when o_orderkey % 5 = 0 then null else concat('order:', cast(o_orderkey as varchar(20))) end as v,
    row_number() over (partition by o_custkey % 200 order by o_orderkey desc) rn from orders) t where rn = 1)
, ov as (select coalesce(w.k, live.k) as k, case when w.k is not null then w.v else live.v end as v
    from live full outer join w on live.k = w.k where w.k is null or w.kind = 'P')
"""


def _batch(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_orderkey") % 5 == 0
    ops = o.select(
        user_key(F.col("o_custkey") % 200).alias("key"), F.when(gone, 2).otherwise(1).alias("kind"),
        F.when(~gone, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("value"), F.col("o_orderkey").alias("op_index"),
    )
    return writes.last_per_key(ops)


@query(_BATCH_SQL + "select k, v from ov")
def batch_overlay(spark, sf_dir):
    return _kv(writes.overlay(hist.visible(history(spark, sf_dir)), _batch(spark, sf_dir)))


@query(_BATCH_SQL + f"select cast(q.pos as bigint) as pos, q.k, ov.v from {_WANTED_SQL.replace(' w(', ' q(')} left join ov on ov.k = q.k")
def tx_read_own_writes(spark, sf_dir):
    over = writes.overlay(hist.visible(history(spark, sf_dir)), _batch(spark, sf_dir))
    return _wanted(spark).join(over, "key", "left").select("pos", F.col("key").alias("k"), F.col("value").alias("v"))


@query("""
, c as (select concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as k, event_id + 1 as seq,
    case event_type when 'purchase' then 'SET' when 'error' then 'DEL' else 'INCR' end as op,
    cast(round(value) as bigint) as amount from events)
, g as (select *, sum(case when op = 'INCR' then 0 else 1 end) over (partition by k order by seq) as seg from c)
, last as (select *, max(seg) over (partition by k) as top from g)
, s as (select k, max(case when op <> 'INCR' then op end) as op, max(case when op = 'SET' then amount end) as base,
    sum(case when op = 'INCR' then amount end) as added from last where seg = top group by k)
select k, cast(coalesce(base, 0) + coalesce(added, 0) as bigint) as v from s where not (op is not null and op = 'DEL' and added is null)""")
def incr_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "SET").when(F.col("event_type") == "error", "DEL").otherwise("INCR")
    c = e.select(user_key(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.round("value").cast("bigint").alias("amount"))
    return writes.fold_counters(c).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("""
, c as (select concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as k, event_id as ticket, cast(1 + event_id % 3 as bigint) as ops,
    event_type <> 'error' as accepted from events)
, t as (select ticket, case when accepted then ops else 0 end as n from c)
, u as (select ticket, n, cast(1000 + sum(n) over (order by ticket) as bigint) as last_seq from t)
select ticket, case when n > 0 then last_seq - n + 1 end as first_seq, last_seq from u""")
def seq_assign(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("event_id").alias("ticket"), (F.col("event_id") % 3 + 1).alias("ops"), (F.col("event_type") != "error").alias("accepted"))
    return writes.first_seqs(entries, 1000)


@query(" select k, count(*) as versions, cast(sum(strlen(k) + coalesce(strlen(v), 0)) as bigint) as n_bytes from h group by k")
def user_bytes(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("versions"), F.sum(hist.user_bytes(h)).cast("long").alias("n_bytes"))



#: A fold of SET, DEL and INCR per key in order, failures included: ``c`` has
#: ``k, pos, op, arg`` with positions from 1.
_FOLD_SQL = """
, s as (select *, case when op = 'INCR' and regexp_full_match(arg, '[+-]?[0-9]+') then try_cast(arg as bigint) end as n from c)
, f(k, pos, value, failed) as (
    select k, pos, case op when 'SET' then arg when 'INCR' then cast(n as varchar) end, case when op = 'INCR' and n is null then cast(1 as bigint) else 0 end from s where pos = 1
    union all
    select s.k, s.pos,
      case s.op when 'SET' then s.arg when 'DEL' then null else case when s.n is null then f.value
        when f.value is not null and (not regexp_full_match(f.value, '[+-]?[0-9]+') or try_cast(f.value as bigint) is null) then f.value
        when cast(coalesce(f.value, '0') as hugeint) + s.n not between -9223372036854775808 and 9223372036854775807 then f.value
        else cast(cast(coalesce(f.value, '0') as hugeint) + s.n as varchar) end end,
      f.failed + case when s.op <> 'INCR' then 0 when s.n is null then 1
        when f.value is not null and (not regexp_full_match(f.value, '[+-]?[0-9]+') or try_cast(f.value as bigint) is null) then 1
        when cast(coalesce(f.value, '0') as hugeint) + s.n not between -9223372036854775808 and 9223372036854775807 then 1 else 0 end
    from f join s on s.k = f.k and s.pos = f.pos + 1)
select k as key, value, failed from (select *, max(pos) over (partition by k) as top from f) t where pos = top"""
_COMMANDS_SQL = """--recursive
, c as (select concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as k, row_number() over (partition by user_id order by event_id) as pos,
    case event_type when 'purchase' then 'SET' when 'error' then 'DEL' else 'INCR' end as op, {0} as arg from events)
"""


@query(_COMMANDS_SQL.format("""case when event_id % 11 = 0 then '9223372036854775807' when event_id % 13 = 0 then ' 5 '
    else cast(cast(round(value) as bigint) as varchar) end""") + _FOLD_SQL)
def incr_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "SET").when(F.col("event_type") == "error", "DEL").otherwise("INCR")
    big = F.when(F.col("event_id") % 11 == 0, F.lit("9223372036854775807")).when(F.col("event_id") % 13 == 0, F.lit(" 5 ")).otherwise(F.round("value").cast("bigint").cast("string"))
    return writes.fold_commands(e.select(user_key(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), big.alias("arg")))


@query("""--recursive
, e as (select user_id % 8 as queue, row_number() over (partition by user_id % 8 order by event_id) as pos, event_id * 7919 % 9000 + 1 as n from events)
, f(queue, pos, grp, total, n) as (
    select queue, pos, cast(0 as bigint), n, n from e where pos = 1
    union all
    select e.queue, e.pos, case when f.total + e.n > 20000 then f.grp + 1 else f.grp end, case when f.total + e.n > 20000 then e.n else f.total + e.n end, e.n
    from f join e on e.queue = f.queue and e.pos = f.pos + 1)
select queue, grp, count(*) as entries, cast(sum(n) as bigint) as n_bytes from f group by queue, grp""")
def group_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select((F.col("user_id") % 8).alias("queue"), F.col("event_id").alias("ticket"), (F.col("event_id") * 7919 % 9000 + 1).alias("bytes"))
    return writes.write_groups(entries, 20000).groupBy("queue", "grp").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("n_bytes"))


_SPLIT_SQL = """--recursive
, e as (select cast(substr(k, 10, 1) as bigint) as part, k, row_number() over (partition by substr(k, 10, 1) order by k, seq desc) as pos,
    strlen(k) + coalesce(strlen(v), 0) + 17 as n from h)
, f(part, pos, file, total, n, k) as (
    select part, pos, cast(0 as bigint), n, n, k from e where pos = 1
    union all
    select e.part, e.pos, case when f.total >= 4096 and e.k <> f.k then f.file + 1 else f.file end,
      case when f.total >= 4096 and e.k <> f.k then e.n else f.total + e.n end, e.n, e.k
    from f join e on e.part = f.part and e.pos = f.pos + 1)
"""


def _merge_entries(spark, sf_dir) -> DataFrame:
    h = history(spark, sf_dir)
    return h.select(F.substring("key", 10, 1).cast("long").alias("part"), "key", "seq", (hist.user_bytes(h) + 17).cast("long").alias("bytes"))


@query(_SPLIT_SQL + "select part, file, min(k) as smallest, max(k) as largest, cast(sum(n) as bigint) as n_bytes from f group by part, file")
def split_files(spark, sf_dir):
    dealt = writes.split_files(_merge_entries(spark, sf_dir), 4096)
    return dealt.groupBy("part", "file").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.sum("bytes").alias("n_bytes"))


# -- transactions ------------------------------------------------------------------------


@query("""
, tx as (select event_id as txid, concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as k, event_id - 50 as read_seq, event_id as commit_seq from events)
select txid, max(case when h.seq is not null then cast(1 as bigint) else 0 end) as conflict from tx left join h on h.k = tx.k and h.seq > tx.read_seq and h.seq <= tx.commit_seq group by txid""")
def tx_conflicts(spark, sf_dir):
    """Every event is a transaction that read 50 numbers before it committed."""
    e = table(spark, sf_dir, "events")
    checked = e.select(F.col("event_id").alias("tx_id"), user_key(F.col("user_id")).alias("key"), (F.col("event_id") - 50).alias("read_seq"), F.col("event_id").alias("commit_seq"))
    return transactions.conflicts(history(spark, sf_dir), checked).withColumnRenamed("tx_id", "txid")


@query("""--recursive
, g as (select event_id // 20 as grp, event_id as ticket, row_number() over (partition by event_id // 20 order by event_id) as pos,
    user_id % 12 as wkey, (user_id + event_id) % 12 as lkey, event_id % 4 <> 0 as tx from events)
, f(grp, pos, ticket, accepted, written) as (
    select grp, pos, ticket, cast(1 as bigint), [wkey] from g where pos = 1
    union all
    select g.grp, g.pos, g.ticket,
      case when g.tx and (list_contains(f.written, g.wkey) or list_contains(f.written, g.lkey)) then cast(0 as bigint) else 1 end,
      case when g.tx and (list_contains(f.written, g.wkey) or list_contains(f.written, g.lkey)) then f.written else list_append(f.written, g.wkey) end
    from f join g on g.grp = f.grp and g.pos = f.pos + 1)
select grp, ticket, accepted from f""")
def tx_group_conflicts(spark, sf_dir):
    """Every 20 events are a write group."""
    return transactions.group_verdicts(_group_entries(table(spark, sf_dir, "events")))


def _group_entries(e: DataFrame) -> DataFrame:
    return e.select(
        F.floor(F.col("event_id") / 20).alias("grp"), F.col("event_id").alias("ticket"), (F.col("event_id") % 4 != 0).alias("tx"),
        F.array(F.col("user_id") % 12).alias("writes"), F.array(F.col("user_id") % 12, (F.col("user_id") + F.col("event_id")) % 12).alias("checks"),
    )


@query("""
, legs as (select event_id + 1 as seq, user_id % 10 as acct, event_id % 7 as amount from events
    union all select event_id + 1, (user_id + 1) % 10, -(event_id % 7) from events)
, b(bound) as (values (10), (500), (5000))
select cast(b.bound as bigint) as bound, count(*) as legs, cast(sum(amount) as bigint) as total from legs join b on legs.seq <= b.bound group by b.bound""")
def sum_invariant(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 7
    legs = e.select((F.col("event_id") + 1).alias("seq"), F.explode(F.array(n, -n)).alias("amount"))
    bounds = spark.createDataFrame([(10,), (500,), (5000,)], "bound long")
    return legs.join(F.broadcast(bounds), F.col("seq") <= F.col("bound")).groupBy("bound").agg(F.count(F.lit(1)).alias("legs"), F.sum("amount").alias("total"))


@query(" select k, v as scanned, v as got from live")
def scan_agrees_with_gets(spark, sf_dir):
    """Every key either read finds, with what a scan and a get of each key say."""
    h = history(spark, sf_dir)
    wanted = h.select("key").distinct().withColumn("pos", F.lit(0).cast("long"))
    points = reads.multi_get(h, wanted).filter("value is not null").select("key", F.col("value").alias("got"))
    scanned = hist.visible(h).select("key", F.col("value").alias("scanned"))
    return scanned.join(points, "key", "full_outer").select(F.col("key").alias("k"), "scanned", "got")


# -- files, levels, manifests ----------------------------------------------------------------


@query(" select cast(floor((seq-1)/250) as bigint) as id, min(k) as smallest, max(k) as largest, count(*) as entry_count, min(seq) as min_seq, max(seq) as max_seq from h group by cast(floor((seq-1)/250) as bigint)")
def file_stats(spark, sf_dir):
    return event_files(spark, sf_dir)


@query(" select id, smallest, largest from ot where not (largest < '0000003500') and smallest < '0000006500'")
def prune_range(spark, sf_dir):
    return files.overlapping(order_files(spark, sf_dir), "0000003500", "0000006500").select("id", "smallest", "largest")


@query(" select ot.id, w.k from ot join (values ('0000000001'), ('0000001000'), ('0000001001'), ('0000009999'), ('9')) w(k) on w.k between ot.smallest and ot.largest")
def prune_keys(spark, sf_dir):
    keys = spark.createDataFrame([("0000000001",), ("0000001000",), ("0000001001",), ("0000009999",), ("9",)], "key string")
    return files.holding(order_files(spark, sf_dir), keys).select("id", F.col("key").alias("k"))


@query("""
, o as (select id, smallest, max(largest) over (order by smallest, id rows between unbounded preceding and 1 preceding) as reach from tb)
select cast(1 as integer) as level, id, smallest, reach from o where reach >= smallest""")
def level_overlaps(spark, sf_dir):
    return files.level_overlaps(event_files(spark, sf_dir).withColumn("level", F.lit(1)))


_MOVABLE = """
select clashes, cast(case when clashes = 0 then 1 else 0 end as bigint) as movable from (
  select (select count(*) from (select smallest, max(largest) over (order by smallest, id rows between unbounded preceding and 1 preceding) as reach from {0} where {1}) t where reach >= smallest)
       + (select count(*) from {0} a where {1} and exists (select 1 from {0} b where {2} and a.smallest <= b.largest and b.smallest <= a.largest)) as clashes) t"""


@query(_MOVABLE.format("ot", "id % 2 = 0", "id % 2 = 1").replace("where id % 2 = 0 and exists", "where a.id % 2 = 0 and exists").replace("where id % 2 = 1 and a.", "where b.id % 2 = 1 and a."))
def trivial_move_ok(spark, sf_dir):
    f = order_files(spark, sf_dir)
    return files.trivial_move(f.filter("id % 2 = 0"), f.filter("id % 2 = 1"))


@query(_MOVABLE.format("tb", "id % 2 = 0", "id % 2 = 1").replace("where id % 2 = 0 and exists", "where a.id % 2 = 0 and exists").replace("where id % 2 = 1 and a.", "where b.id % 2 = 1 and a."))
def trivial_move_refused(spark, sf_dir):
    f = event_files(spark, sf_dir)
    return files.trivial_move(f.filter("id % 2 = 0"), f.filter("id % 2 = 1"))


_LEVELLED = ", lv as (select *, cast(case when id % 3 = 0 then 0 when id % 3 = 1 then 1 else 2 end as integer) as level, n_bytes * 1000 as n from ot), lvl(level) as (values (0), (1), (2), (3), (4), (5), (6))"
_TOTALS = "(select lvl.level, count(lv.id) as n_files, cast(coalesce(sum(lv.n), 0) as bigint) as n_bytes from lvl left join lv on lv.level = lvl.level group by lvl.level) t"


def _levelled(spark, sf_dir) -> DataFrame:
    return order_files(spark, sf_dir).withColumn("level", F.pmod("id", F.lit(3)).cast("int")).withColumn("file_size", F.col("file_size") * 1000)


@query(_LEVELLED + f" select cast(level as integer) as level, n_files, n_bytes from {_TOTALS}")
def level_totals(spark, sf_dir):
    return files.level_totals(_levelled(spark, sf_dir))


@query(_LEVELLED + f" select cast(level as integer) as level, case when level = 0 then n_files / 4.0 else n_bytes / (10485760.0 * power(10, level - 1)) end as score from {_TOTALS} where level < 6")
def level_scores(spark, sf_dir):
    return files.level_scores(_levelled(spark, sf_dir))


@query(_LEVELLED + f""" select cast(level as integer) as level from (select level, case when level = 0 then n_files / 4.0 else n_bytes / (10485760.0 * power(10, level - 1)) end as score
from {_TOTALS} where level < 6) s where score >= 1.0 order by score desc, level desc limit 1""")
def pick_level(spark, sf_dir):
    return files.pick_level(_levelled(spark, sf_dir)).select("level")


@query(_LEVELLED + """
, own as (select id, smallest, largest, level from lv where level = 1 order by case when smallest > '0000005000' then 0 else 1 end, smallest limit 1)
select id, level from own union all select lv.id, lv.level from lv, own where lv.level = 2 and lv.largest >= own.smallest and lv.smallest <= own.largest""")
def pick_inputs(spark, sf_dir):
    return files.pick_inputs(_levelled(spark, sf_dir), 1, "0000005000").select("id", "level")


_EDITS_SQL = """
, edits as (select o_orderkey as pos, o_custkey % 300 as id, case when o_orderstatus = 'F' then 'REMOVE' else 'ADD' end as op,
    cast(o_orderkey % 8 as integer) as level from orders)
"""


def _edits(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 300).alias("id"), F.when(F.col("o_orderstatus") == "F", "REMOVE").otherwise("ADD").alias("op"),
        (F.col("o_orderkey") % 8).cast("int").alias("level"),
    )


@query(_EDITS_SQL + " select id, level from (select *, row_number() over (partition by id order by pos desc) rn from edits) t where rn = 1 and op = 'ADD'")
def manifest_replay(spark, sf_dir):
    return files.live_files(_edits(spark, sf_dir))


@query(_EDITS_SQL + """
, e as (select *, lag(op) over (partition by id order by pos) as was from edits)
select pos, 'duplicate add' as reason from e where op = 'ADD' and was = 'ADD'
union all select pos, 'unknown remove' from e where op = 'REMOVE' and (was is null or was <> 'ADD')
union all select pos, 'bad level' from e where op = 'ADD' and (level < 0 or level > 6)""")
def manifest_violations(spark, sf_dir):
    return files.edit_violations(_edits(spark, sf_dir))


@query("""
, l as (select id, concat(lpad(cast(id as varchar(20)), 6, '0'), case id % 4 when 0 then '.sst' when 1 then '.log' when 2 then '.tmp' else '.txt' end) as name from ot)
select name from l where id % 4 = 2 or (id % 4 = 1 and id < 6) or (id % 4 = 0 and id % 8 <> 0)""")
def obsolete_files(spark, sf_dir):
    f = order_files(spark, sf_dir)
    suffix = F.when(F.col("id") % 4 == 0, ".sst").when(F.col("id") % 4 == 1, ".log").when(F.col("id") % 4 == 2, ".tmp").otherwise(".txt")
    listing = f.select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), suffix).alias("name"))
    return files.obsolete(listing, f.filter("id % 8 = 0").select("id"), 6)


# -- measures ----------------------------------------------------------------------------------


@query("""
, m as (select case when event_type = 'error' then 'compaction' when event_type = 'view' then 'flush' else 'user' end as kind, cast(event_id % 1000 as bigint) as n from events)
, s as (select cast(coalesce(sum(case when kind = 'user' then n end), 0) as bigint) as user_bytes, cast(coalesce(sum(case when kind = 'flush' then n end), 0) as bigint) as flush_bytes,
    cast(coalesce(sum(case when kind = 'compaction' then n end), 0) as bigint) as compaction_bytes from m)
select *, case when user_bytes > 0 then (flush_bytes + compaction_bytes) / cast(user_bytes as double) else 0.0 end as write_amp from s""")
def write_amp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "compaction").when(F.col("event_type") == "view", "flush").otherwise("user")
    return stats.write_amplification(e.select(kind.alias("kind"), (F.col("event_id") % 1000).alias("n_bytes")))


@query("""
, r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, min(case when i = least(cast(floor(n * 0.5) as bigint), n - 1) then value end) as p50,
  min(case when i = least(cast(floor(n * 0.99) as bigint), n - 1) then value end) as p99,
  min(case when i = least(cast(floor(n * 0.999) as bigint), n - 1) then value end) as p999 from r group by event_type""")
def latency_pct(spark, sf_dir):
    return stats.percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, ["event_type"])


@query("""
select count(*) as versions, count(distinct k) as keys_seen, (select count(*) from live) as live_keys, count(*) filter (where kind = 'D') as deletions,
  cast(sum(strlen(k) + coalesce(strlen(v), 0)) as bigint) as user_bytes, max(seq) as last_sequence from h""")
def store_counts(spark, sf_dir):
    return stats.store_counts(history(spark, sf_dir))


# -- filters, cache, buffers, whole-log checks ------------------------------------------------


@query(" select count(*) as probes, count(*) as maybe from (select distinct cast(floor((seq-1)/250) as bigint) as id, k from h) t")
def bloom_no_false_negatives(spark, sf_dir):
    entries = history(spark, sf_dir).select(F.floor((F.col("seq") - 1) / 250).alias("id"), "key")
    found = filters.probe_filters(filters.build_filters(entries), entries.distinct())
    return found.agg(F.count(F.lit(1)).alias("probes"), F.count_if("maybe").alias("maybe"))


@query("""--recursive
, e as (select event_id % 4 as queue, row_number() over (partition by event_id % 4 order by event_id) as pos, user_id * user_id % 97 as block, user_id % 5 * 100 + 100 as n from events)
, f(queue, pos, hit, held) as (
    select queue, pos, cast(0 as bigint), [{'b': block, 'n': n}] from e where pos = 1
    union all
    select e.queue, e.pos, case when list_contains(list_transform(f.held, lambda x: x.b), e.block) then cast(1 as bigint) else 0 end,
      -- the accessed block first, with the size it came with; then as many of the others, in order, as fit
      (select list(struct_pack(b := b, n := n) order by i) from (
         select i, b, n, sum(n) over (order by i) as used from (
           select 0 as i, e.block as b, coalesce(list_filter(f.held, lambda x: x.b = e.block)[1].n, e.n) as n
           union all
           select unnest(range(1, len(f.held) + 1)), unnest(list_transform(f.held, lambda x: x.b)), unnest(list_transform(f.held, lambda x: x.n))) t
         where i = 0 or b <> e.block) u where used <= 4000)
    from f join e on e.queue = f.queue and e.pos = f.pos + 1)
select queue, count(*) as accesses, cast(sum(hit) as bigint) as hits from f group by queue""")
def lru_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    accesses = e.select((F.col("event_id") % 4).alias("queue"), F.col("event_id").alias("ticket"), (F.col("user_id") * F.col("user_id") % 97).alias("block"), (F.col("user_id") % 5 * 100 + 100).alias("bytes"))
    return filters.cache_hits(accesses, 4000).groupBy("queue").agg(F.count(F.lit(1)).alias("accesses"), F.sum("hit").alias("hits"))


@query("""--recursive
, e as (select seq % 4 as queue, row_number() over (partition by seq % 4 order by seq) as pos, strlen(k) + coalesce(strlen(v), 0) + 8 as n from h)
, f(queue, pos, buffer, total, n) as (
    select queue, pos, cast(0 as bigint), n, n from e where pos = 1
    union all
    select e.queue, e.pos, case when f.total >= 4096 then f.buffer + 1 else f.buffer end, case when f.total >= 4096 then e.n else f.total + e.n end, e.n
    from f join e on e.queue = f.queue and e.pos = f.pos + 1)
select queue, buffer, count(*) as versions, cast(sum(n) as bigint) as n_bytes from f group by queue, buffer""")
def memtable_switches(spark, sf_dir):
    h = history(spark, sf_dir)
    entries = h.select((F.col("seq") % 4).alias("queue"), "seq", (hist.user_bytes(h) + 8).cast("long").alias("bytes"))
    return filters.memtable_switches(entries, 4096).groupBy("queue", "buffer").agg(F.count(F.lit(1)).alias("versions"), F.sum("bytes").alias("n_bytes"))


@query(_SPLIT_SQL + " select k, part, min(file) as first_file, max(file) as last_file from f group by k, part")
def keys_within_one_file(spark, sf_dir):
    """The file of every key: first and last one are the same when files are cut at key boundaries."""
    spans = writes.split_files(_merge_entries(spark, sf_dir), 4096).groupBy("part", "key").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"))
    return spans.withColumnRenamed("key", "k")


@query(_COMMANDS_SQL.format("case when event_type = 'purchase' then cast(cast(round(value) as bigint) as varchar) else '1' end") + _FOLD_SQL)
def exec_replies(spark, sf_dir):
    """Wire requests of one session per user, parsed and folded to counters."""
    from palimpsest.sources import resp

    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "purchase", "SET").when(F.col("event_type") == "error", "DEL").otherwise("INCR")
    arg = F.round("value").cast("bigint").cast("string")
    line = F.concat(F.concat_ws(" ", name, user_key(F.col("user_id")), F.when(name == "SET", arg)), F.lit("\r\n"))
    parsed = resp.commands(e.select(F.col("event_id").alias("id"), line.cast("binary").alias("data")))
    text = lambda k: F.decode(F.get("args", F.lit(k)), "UTF-8")
    c = parsed.select(text(0).alias("key"), (F.col("id") + 1).alias("seq"), F.col("name").alias("op"), F.coalesce(text(1), F.lit("1")).alias("arg"))
    return writes.fold_commands(c)


@query()
def store_round_trip(spark, sf_dir):
    """Write the history into a store, compact it, and read the latest pairs back."""
    import uuid

    from palimpsest.store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    h = history(spark, sf_dir)
    store.write_frame(h.select(F.col("seq").alias("op_index"), "kind", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))
    store.compact_all()
    return store.scan().select(F.col("key").cast("string").alias("k"), "seq", F.col("value").cast("string").alias("v"))


ORACLES["store_round_trip"] = ORACLES["scan_latest"]
