"""Batches, sequence numbers, counters and write groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import GROUP_BYTES, PUT
from palimpsest.functions.integers import HIGH, LOW, parse
from palimpsest.shipping import ship


def last_per_key(ops: DataFrame) -> DataFrame:
    """One row per key of ``key, kind, value, op_index``: the later operation wins."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("op_index")))
    return ops.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank", "op_index")


def overlay(live: DataFrame, writes: DataFrame) -> DataFrame:
    """Live pairs under buffered writes ``key, kind, value``; a buffered deletion hides."""
    own = writes.select("key", F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    both = live.select("key", "value").join(own, "key", "full_outer")
    return both.filter(F.col("_kind").isNull() | (F.col("_kind") == PUT)).select("key", F.when(F.col("_kind").isNotNull(), F.col("_value")).otherwise(F.col("value")).alias("value"))


def first_seqs(entries: DataFrame, last_seq: int) -> DataFrame:
    """First sequence number of every accepted entry ``ticket, ops``, in ticket order.

    Refused or empty entries take none.  The running sum goes block by block:
    block totals first (one row per 4096 tickets), then within blocks.
    """
    took = entries.withColumn("_n", F.when(F.col("accepted"), F.col("ops")).otherwise(F.lit(0)).cast("long")).withColumn("_block", F.floor(F.col("ticket") / 4096))
    totals = took.groupBy("_block").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("ticket").rowsBetween(Window.unboundedPreceding, 0)
    summed = took.withColumn("_sum", F.sum("_n").over(inside)).join(bases, "_block")
    first = F.when(F.col("_n") > 0, F.lit(last_seq) + F.col("_base") + F.col("_sum") - F.col("_n") + 1)
    return summed.select("ticket", first.cast("long").alias("first_seq"), (F.lit(last_seq) + F.col("_base") + F.col("_sum")).cast("long").alias("last_seq"))


def fold_counters(commands: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Final counters of a stream ``key, seq, op, amount`` of SET, DEL and INCR.

    Only the last SET or DEL of a key and the increments after it matter.  Both are
    plain aggregates with partial sums, so one hot counter is no bottleneck.  Exact
    as long as no command fails; see :func:`fold_commands` for failures.
    """
    reset = commands.filter("op <> 'INCR'").groupBy("key").agg(
        F.max("seq").alias("_at"), F.max_by("op", "seq").alias("_op"), F.max_by("amount", "seq").alias("_amount")
    )
    rest = commands.filter("op = 'INCR'").join(reset.select("key", "_at"), "key", "left").filter("_at is null or seq > _at")
    added = rest.groupBy("key").agg(F.sum("amount").alias("_added"))
    both = reset.join(added, "key", "full_outer")
    start = F.when(F.col("_op") == "SET", F.col("_amount")).when(F.col("_op") == "DEL", F.lit(0))
    if base is not None:
        both = both.join(base.select("key", F.col("value").alias("_base")), "key", "left")
        start = F.coalesce(start, F.col("_base"))
    gone = (F.col("_op") == "DEL") & F.col("_added").isNull()
    return both.filter(~F.coalesce(gone, F.lit(False))).select("key", (F.coalesce(start, F.lit(0)) + F.coalesce("_added", F.lit(0))).cast("long").alias("value"))


def _whole(c: Column) -> Column:
    """A text as a 64-bit integer, null where it is none."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))


def fold_commands(commands: DataFrame) -> DataFrame:
    """Exact end value and failure count per key, command by command.

    ``commands`` has ``key, seq, op, arg`` with text arguments.  An increment of a
    value that is no 64-bit integer, or that would overflow, fails and changes
    nothing; later commands still run.

    Every SET or DEL begins a run of its own.  Within a run, running sums of the
    valid increments tell whether any of them overflows; if none does, end value and
    failures are plain aggregates.  The runs with an overflow are folded one command
    after the other, passing by in order; nothing collects a key's commands.
    """
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = commands.withColumn("_run", F.count_if(F.col("op") != "INCR").over(order))
    base = F.when(F.col("op") == "SET", F.col("arg"))
    by = F.when(F.col("op") == "INCR", _whole(F.col("arg"))).cast("decimal(38,0)")
    sofar = F.sum(by).over(Window.partitionBy("key", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ends = runs.withColumns({"_base": base, "_by": by, "_sofar": sofar}).groupBy("key", "_run").agg(
        F.max("_base").alias("base"), F.sum("_by").alias("added"), F.min("_sofar").alias("least"), F.max("_sofar").alias("most"),
        F.count_if(F.col("op") == "INCR").alias("steps"), F.count("_by").alias("valid"),
    )
    number = F.when(F.col("base").isNotNull(), _whole(F.col("base"))).otherwise(F.lit(0)).cast("decimal(38,0)")
    stuck = number.isNull()  # a text no increment can change
    over = ~stuck & ((number + F.col("most") > HIGH) | (number + F.col("least") < LOW))
    judged = ends.withColumns({"_number": number, "_stuck": stuck, "_over": F.coalesce(over, F.lit(False))})
    plain = judged.filter(~F.col("_over")).select(
        "key", "_run", F.when(F.col("_stuck") | (F.col("valid") == 0), F.col("base")).otherwise((F.col("_number") + F.col("added")).cast("bigint").cast("string")).alias("value"),
        F.when(F.col("_stuck"), F.col("steps")).otherwise(F.col("steps") - F.col("valid")).alias("failed"),
    )
    slow = runs.join(judged.filter("_over").select("key", "_run"), ["key", "_run"], "left_semi").select("key", "_run", "seq", "op", "arg")

    def run(batches):
        import pyarrow as pa

        at, value, failed = None, None, 0

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["key", "_run", "value", "failed"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64()]
            done = []
            for key, nr, op, arg in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if at != (key, nr):
                    if at is not None:
                        done.append((*at, value, failed))
                    at, value, failed = (key, nr), None, 0
                if op != "INCR":
                    value = arg if op == "SET" else None
                    continue
                total, step = 0 if value is None else parse(value.encode()), None if arg is None else parse(arg.encode())
                if total is None or step is None or not LOW <= total + step <= HIGH:
                    failed += 1
                else:
                    value = str(total + step)
            if done:
                yield rows(done)
        if at is not None:
            yield rows([(*at, value, failed)])

    ship(commands.sparkSession)
    kind = dict(commands.dtypes)["key"]
    exact = slow.repartition("key", "_run").sortWithinPartitions("key", "_run", "seq").mapInArrow(run, f"key {kind}, _run long, value string, failed long")
    every = plain.unionByName(exact)
    return every.groupBy("key").agg(F.max_by(F.struct("value"), "_run").alias("_last"), F.sum("failed").alias("failed")).select("key", "_last.value", "failed")


def greedy_cuts(entries: DataFrame, number: str, out: str, limit: int, ends_full: bool, block: int = 1 << 14) -> DataFrame:
    """Greedy groups over each queue's entries ``queue, number, bytes`` in order.

    With ``ends_full`` a group ends with the entry that reaches ``limit``; without it
    before the entry that would exceed it.  Either way it has its first entry.

    The entries are dealt into blocks of consecutive numbers.  A block cannot know how
    full the group is that reaches into it, but that group's end is one of its first
    few entries, and from there on all is determined.  So every block tells, for each
    entry its first own group may begin with, how many groups it has and how full the
    last one stays; these short tables are walked per queue, and each block is then
    numbered on its own.  As many tasks work as there are blocks, not queues.
    """
    rows = entries.select("queue", number, "bytes").withColumn("_block", F.floor(F.col(number) / block))

    def jumps(sizes):
        """Running sums, and for each entry the first entry of the group after its own."""
        import numpy as np

        sums = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(sizes))
        if ends_full:
            after = np.searchsorted(sums, sums[:-1] + limit, "left")
        else:
            after = np.searchsorted(sums, sums[:-1] + limit, "right") - 1
        return sums, np.maximum(after, at + 1)

    def first_cut(sums, carry):
        """The entry a new group begins with, if one of size ``carry`` reaches into the block."""
        import numpy as np

        if carry < 0:  # nothing reaches in
            return 0
        if ends_full:
            return int(np.searchsorted(sums, limit - carry, "left"))
        return max(0, int(np.searchsorted(sums, limit - carry, "right")) - 1)

    def table(key, t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by(number)
        sizes = t.column("bytes").to_numpy().astype(np.int64)
        n = len(sizes)
        sums, after = jumps(sizes)
        count, full = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        whole = int(sums[n])
        for i, (j, s) in enumerate(zip(after[::-1].tolist(), sums[n - 1 :: -1].tolist(), strict=True)):
            at = n - 1 - i
            count[at], full[at] = (count[j] + 1, full[j]) if j < n else (1, whole - s)
        reach = min(n, first_cut(sums, 0))  # no group that reaches in ends later
        same = lambda x: np.full(reach + 1, x)
        columns = [same(key[0].as_py()), same(key[1].as_py()), np.arange(reach + 1), sums[: reach + 1], count[: reach + 1], full[: reach + 1], same(whole), same(n)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["queue", "_block", "cut", "upto", "count", "full", "total", "size"])

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        queue, block_at, lines, carry, group = None, None, [], -1, -1

        def pass_block():
            """Where the block's first own group begins and its number, moving on to the next block."""
            nonlocal carry, group
            upto = np.array([x[1] for x in lines])
            _, _, _, _, total, size = lines[0]
            cut = min(first_cut(upto, carry), len(lines) - 1)
            row = (queue, block_at, carry, group)
            if carry >= 0 and cut >= size:
                carry += total
            else:
                group += int(lines[cut][2])
                carry = int(lines[cut][3])
            return row

        for batch in batches:
            done = []
            for q, b, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q, b) != (queue, block_at):
                    if lines:
                        done.append(pass_block())
                    if q != queue:
                        carry, group = -1, -1
                    queue, block_at, lines = q, b, []
                lines.append(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["queue", "_block", "carry", "before"])
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in pass_block()], names=["queue", "_block", "carry", "before"])

    def number_block(key, left, right):
        import numpy as np
        import pyarrow as pa

        left = left.sort_by(number)
        sizes = left.column("bytes").to_numpy().astype(np.int64)
        carry, before = right.column("carry")[0].as_py(), right.column("before")[0].as_py()
        sums, after = jumps(sizes)
        begins = np.zeros(len(sizes), np.int64)
        i, hop = min(first_cut(sums, carry), len(sizes)), after.tolist()
        while i < len(sizes):
            begins[i] = 1
            i = hop[i]
        return pa.table({"queue": left.column("queue"), number: left.column(number), "bytes": left.column("bytes"), out: pa.array(before + np.cumsum(begins))})

    ship(entries.sparkSession)
    tables = rows.groupBy("queue", "_block").applyInArrow(table, "queue long, _block long, cut long, upto long, count long, full long, total long, size long")
    entry = tables.repartition("queue").sortWithinPartitions("queue", "_block", "cut").mapInArrow(walk, "queue long, _block long, carry long, before long")
    return rows.groupBy("queue", "_block").cogroup(entry.groupBy("queue", "_block")).applyInArrow(number_block, f"queue long, {number} long, bytes long, {out} long")


def write_groups(entries: DataFrame, limit: int = GROUP_BYTES) -> DataFrame:
    """Group number of every queued entry ``queue, ticket, bytes``.

    A group takes its first entry whatever its size, then more while the total
    stays within the limit.
    """
    return greedy_cuts(entries, "ticket", "grp", limit, ends_full=False)


def split_files(entries: DataFrame, target: int) -> DataFrame:
    """File number of every sorted entry ``part, key, seq, bytes`` of a merge.

    A file ends at the first new key after it reached the target size; versions of
    one key never part.  ``part`` is a key range of its own, as a merge deals them.
    Keys are summed up first, so what is walked is one row per key, by jumps over
    running sums; memory holds a batch of keys.
    """
    ship(entries.sparkSession)
    totals = entries.groupBy("part", "key").agg(F.sum("bytes").alias("_bytes"))
    kind = dict(entries.dtypes)["key"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        part, file, full = None, 0, 0
        for batch in batches:
            parts, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            files = np.zeros(len(parts), np.int64)
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != part:
                    part, file, full = parts[a], 0, 0
                sums = np.concatenate([[0], np.cumsum(sizes[a:b])])
                i, begins = int(np.searchsorted(sums, target - full, "left")), np.zeros(b - a, np.int64)
                last = -1
                while i < b - a:
                    begins[i], last = 1, i
                    i = max(i + 1, int(np.searchsorted(sums, sums[i] + target, "left")))
                files[a:b] = file + np.cumsum(begins)
                file = int(files[b - 1])
                full = int(sums[-1] - sums[last]) if last >= 0 else full + int(sums[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files)], names=["part", "key", "file"])

    dealt = totals.repartition("part").sortWithinPartitions("part", "key").mapInArrow(run, f"part long, key {kind}, file long")
    return entries.select("part", "key", "seq", "bytes").join(dealt, ["part", "key"])
