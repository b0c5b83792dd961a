"""File metadata: statistics, pruning, levels, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import FORMATS, LEVELS, Options

#: Cells the key space is cut into where keys and files meet.
CELLS = 128


def file_stats(entries: DataFrame, file: str = "id") -> DataFrame:
    """Key range, counts and sequence range of every file of ``entries``."""
    return entries.groupBy(F.col(file).alias("id")).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("entry_count"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def overlapping(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files that may hold keys of the half-open range ``[low, high)``."""
    test = F.lit(True)
    if low is not None:
        test = test & ~(F.col("largest") < F.lit(low))
    if high is not None:
        test = test & (F.col("smallest") < F.lit(high))
    return files.filter(test)


def holding(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs ``id, key`` of files whose key range covers a wanted key.

    Some of the files' smallest keys cut the key space into cells; keys and files
    meet by cell, a file once for each cell it reaches into.  Files of sorted levels
    reach into few, and neither side is broadcast.
    """
    cuts = [r["smallest"] for r in files.filter("smallest is not null").select("smallest").distinct().orderBy(F.xxhash64("smallest")).limit(CELLS).collect()]
    cuts = sorted(bytes(c) if isinstance(c, bytearray) else c for c in cuts)

    def cell(c: Column) -> Column:
        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            cut = F.lit(bytearray(cuts[middle]) if isinstance(cuts[middle], bytes) else cuts[middle])
            return F.when(c < cut, search(low, middle)).otherwise(search(middle + 1, high))

        return search(0, len(cuts))

    ranges = files.filter("smallest is not null").select("id", "smallest", "largest", F.explode(F.sequence(cell(F.col("smallest")), cell(F.col("largest")))).alias("_cell"))
    wanted = keys.select("key").filter("key is not null").distinct().withColumn("_cell", cell(F.col("key")))
    return ranges.join(wanted, "_cell").filter(F.col("key").between(F.col("smallest"), F.col("largest"))).select("id", "key")


def level_overlaps(files: DataFrame) -> DataFrame:
    """Neighbours within a level (from 1 on) that are not strictly disjoint.

    Any row, or an empty file below level 0, is corruption.
    """
    before = Window.partitionBy("level").orderBy("smallest", "id").rowsBetween(Window.unboundedPreceding, -1)
    edges = files.filter("level >= 1").withColumn("reach", F.max("largest").over(before))
    return edges.filter(F.col("smallest").isNull() | (F.col("reach") >= F.col("smallest"))).select("level", "id", "smallest", "reach")


def trivial_move(inputs: DataFrame, next_level: DataFrame) -> DataFrame:
    """One row ``clashes, movable``: whether files may move down by metadata alone.

    No input may be empty, inputs must be strictly disjoint, and nothing in the
    next level may overlap any of them.  One walk over the sorted edges of both, a
    row per file: an input clashes with another file if the furthest end before its
    start, or the least start after it, lies within it.
    """
    edges = inputs.select("smallest", "largest", "entry_count", F.lit(True).alias("_own"), "id").unionByName(
        next_level.select("smallest", "largest", "entry_count", F.lit(False).alias("_own"), "id")
    )
    past = Window.orderBy("smallest", "_own", "id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("smallest", "_own", "id").rowsBetween(1, Window.unboundedFollowing)
    other = lambda c: F.when(~F.col("_own"), F.col(c))
    walked = edges.withColumns({
        "_reach": F.max(F.when(F.col("_own"), F.col("largest"))).over(past), "_far": F.max(other("largest")).over(past), "_next": F.min(other("smallest")).over(ahead),
    })
    own = F.col("_own") & ((F.col("_reach") >= F.col("smallest")) | (F.col("entry_count") == 0))
    met = F.col("_own") & ((F.col("_far") >= F.col("smallest")) | (F.col("_next") <= F.col("largest")))
    both = walked.agg((F.count_if(own) + F.count_if(met)).alias("clashes"))
    return both.select("clashes", (F.col("clashes") == 0).cast("long").alias("movable"))


def level_totals(files: DataFrame) -> DataFrame:
    """File count and bytes of every level, empty ones included."""
    levels = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("n_bytes"))
    return levels.join(sums, "level", "left").select("level", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))


def level_scores(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Urgency of each level: files over the trigger, or bytes over the limit.

    The bottom level is never compacted on its own.
    """
    o = options or Options()
    limit: Column = F.lit(None).cast("double")
    for level in range(1, LEVELS - 1):
        limit = F.when(F.col("level") == level, F.lit(float(o.level_limit(level)))).otherwise(limit)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(o.l0_compaction_trigger))).otherwise(F.col("n_bytes") / limit)
    return level_totals(files).filter(F.col("level") < LEVELS - 1).select("level", score.alias("score"))


def pick_level(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The most urgent level with a score of 1 or more; the deeper one of equals."""
    return level_scores(files, options).filter("score >= 1.0").orderBy(F.desc("score"), F.desc("level")).limit(1)


def pick_inputs(files: DataFrame, level: int, pointer=None) -> DataFrame:
    """Files a compaction of ``level`` reads: its own, and the next level's overlaps.

    Level 0 gives all its files, the bottom level too (rewritten in place), any
    other the first file after the rotation pointer, or else the first.
    """
    own = files.filter(F.col("level") == level)
    if 0 < level < LEVELS - 1:
        after = F.lit(1) if pointer is None else F.when(F.col("smallest") > F.lit(pointer), 0).otherwise(1)
        own = own.orderBy(after, "smallest").limit(1)
    if level == LEVELS - 1:
        return own
    span = own.agg(F.min("smallest").alias("_lo"), F.max("largest").alias("_hi"))  # one row
    down = files.filter(F.col("level") == level + 1).join(F.broadcast(span), (F.col("largest") >= F.col("_lo")) & (F.col("smallest") <= F.col("_hi"))).drop("_lo", "_hi")
    return own.unionByName(down)


def live_files(edits: DataFrame) -> DataFrame:
    """Live files ``id, level`` after replaying ``pos, op, id, level``: last edit wins.

    Aggregates over plain numbers, so edits are hashed and not sorted, however many one
    task reads; an edit without a position comes before all others.
    """
    at = F.coalesce(F.col("pos").cast("long"), F.lit(-(1 << 63)))
    tables = edits.filter(F.col("op").isin("ADD", "REMOVE"))
    last = tables.groupBy("id").agg(F.max_by(F.col("op") == "ADD", at).alias("_live"), F.max_by("level", at).alias("level"))
    return last.filter("_live").select("id", "level")


def edit_violations(edits: DataFrame) -> DataFrame:
    """Edits no valid log holds: ``pos, reason``.

    A file added twice or at no level, removed while not live; a log number or last
    sequence going back; a format that does not rise or is unknown.
    """
    by_file = Window.partitionBy("id").orderBy("pos")
    tables = edits.filter(F.col("op").isin("ADD", "REMOVE")).withColumn("_was", F.lag("op").over(by_file))
    duplicate = tables.filter((F.col("op") == "ADD") & (F.col("_was") == "ADD")).select("pos", F.lit("duplicate add").alias("reason"))
    unknown = tables.filter((F.col("op") == "REMOVE") & ((F.col("_was") != "ADD") | F.col("_was").isNull())).select("pos", F.lit("unknown remove").alias("reason"))
    level = tables.filter((F.col("op") == "ADD") & ~F.col("level").between(0, LEVELS - 1)).select("pos", F.lit("bad level").alias("reason"))
    by_op = Window.partitionBy("op").orderBy("pos")
    marks = edits.filter(F.col("op").isin("LOGNUM", "LASTSEQ", "FORMAT")).withColumn("_was", F.lag("id").over(by_op))
    back = marks.filter((F.col("op") != "FORMAT") & (F.col("id") < F.col("_was"))).select("pos", F.lit("going back").alias("reason"))
    formats = marks.filter((F.col("op") == "FORMAT") & ((F.col("id") <= F.col("_was")) | ~F.col("id").isin(*FORMATS))).select("pos", F.lit("bad format").alias("reason"))
    return duplicate.unionByName(unknown).unionByName(level).unionByName(back).unionByName(formats)


def obsolete(listing: DataFrame, live: DataFrame, log_number: int) -> DataFrame:
    """Files of a directory listing ``name`` that recovery deletes.

    Temporary files, logs below the log number, tables that are not live; files of
    no known kind are left alone.
    """
    number = F.regexp_extract("name", r"^([0-9]+)\.(log|sst)$", 1).try_cast("bigint")
    kind = F.regexp_extract("name", r"\.(tmp|log|sst)$", 1)
    rows = listing.withColumn("_id", number).withColumn("_kind", kind)
    known = live.select(F.col("id").alias("_id"), F.lit(True).alias("_live"))
    dead = (F.col("_kind") == "tmp") | ((F.col("_kind") == "log") & (F.col("_id") < log_number)) | ((F.col("_kind") == "sst") & F.col("_id").isNotNull() & F.col("_live").isNull())
    return rows.join(known, "_id", "left").filter(dead).select("name")
