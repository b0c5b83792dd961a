"""Exact duplicate detection with a two-pass Bloom filter (DataFrame code only).

Pass one hashes every text into two slot spaces and counts the hits of each
slot; slots hit at least twice form the filter.  Pass two looks both slots of
every row up: a row with a slot hit once cannot have a copy and goes straight to
the output.  The remaining rows are grouped by their SHA-256, so a false positive
of the filter costs a shuffled row and never a wrong answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Most slots of each of the two hash functions: at most ``2 * MOST / 64`` rows of
#: two longs (67 MB) are broadcast, however large the input is.
MOST = 1 << 27
#: Slots a row of the input, up to ``MOST``.
ROOM = 8
#: A group of equal texts is heavy if it has this share of all possible copies, so
#: there are at most this many heavy groups to broadcast.
HEAVY = 1000


def slots_for(rows: int) -> int:
    """Slots of each hash function for so many rows: a power of two, ``ROOM`` a row."""
    return min(MOST, 1 << max(16, (ROOM * rows - 1).bit_length()))


def _slots(h: Column, slots: int) -> tuple[Column, Column]:
    """Slot numbers under the two hash functions, in disjoint ranges."""
    return F.pmod(h, F.lit(slots)), F.pmod(F.shiftrightunsigned(h, 30), F.lit(slots)) + F.lit(slots)


def repeated_slots(texts: DataFrame, slots: int) -> DataFrame:
    """Filter words ``(word, mask)``: a set bit is a slot hit at least twice.

    Only words with a set bit are rows, so the filter of few copies is small.
    """
    one, two = _slots(F.xxhash64("text"), slots)
    hit = texts.select(F.explode(F.array(one, two)).alias("slot")).groupBy("slot").count()
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    return (
        hit.filter("count > 1")
        .select(F.floor(F.col("slot") / 64).alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("mask"))
    )


def _split(docs: DataFrame, id_col: str, text_col: str, carry: list[Column], slots: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows proved unique by the filter, and the other rows with their groups.

    The few heavy groups are broadcast, and their rows stay where they lie; only
    the rows of the other groups, each a small share of all, shuffle to meet theirs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    slots = slots or slots_for(docs.count())
    words = F.broadcast(written(repeated_slots(rows, slots), "filter"))  # at most 2 * slots / 64 rows
    one, two = _slots(F.xxhash64("text"), slots)
    probed = rows.withColumns({"s1": one, "s2": two})
    for k in ("1", "2"):
        probed = probed.join(
            words.select(F.col("word").alias("w" + k), F.col("mask").alias("m" + k)),
            F.floor(F.col("s" + k) / 64) == F.col("w" + k),
            "left",
        )
    hit = [F.expr(f"coalesce(shiftrightunsigned(m{k}, cast(s{k} % 64 as int)) & 1L, 0L) = 1L") for k in "12"]
    maybe = hit[0] & hit[1]
    held = [c for c in rows.columns if c != "text"]
    sha = F.sha2(F.col("text"), 256).alias("text_sha256")
    alone = probed.filter(~maybe).select(*held, sha)
    suspects = probed.filter(maybe).select(*held, sha)
    sizes = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(suspects.groupBy("text_sha256").agg(*sizes), "copies")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    heavy = F.col("group_size") * HEAVY >= F.lit(total)
    seen = suspects.join(F.broadcast(groups.filter(heavy)), "text_sha256", "left")  # at most HEAVY rows
    hot, cold = seen.filter("group_size is not null"), seen.filter("group_size is null").drop("keep_id", "group_size")
    return alone, hot.unionByName(cold.join(groups.filter(~heavy), "text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """Every row with the row of its group of equal texts that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input
    row.  The largest id of equal texts stays.  Null text equals empty text.
    Rows that repeat both id and text are one document: they carry the same
    decision and count separately in ``group_size``.  A null id never wins over
    another id; if all ids of a group are null, ``keep_id`` is null and all rows
    are kept.  An empty table gives an empty result; other columns are ignored.
    The filter has ``slots`` slots, by default as many as the rows call for.
    """
    alone, met = _split(docs, id_col, text_col, [], slots)
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """``docs`` without the rows whose text a kept row already has; all columns stay.

    Decisions are those of :func:`exact_groups`.  Rows the filter proves unique and
    rows of heavy groups keep their place; only the other suspects are shuffled.
    """
    alone, met = _split(docs, id_col, text_col, [F.struct("*").alias("whole")], slots)
    return alone.select("whole.*").unionByName(met.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("whole.*"))
