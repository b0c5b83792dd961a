"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two 32-bit segments.  Two fingerprints that differ in at
most three bits differ in at most one bit within at least one segment, so each
segment's keys are looked up with the Hamming ball of radius one around them.
Of two keys one bit apart exactly one has that bit clear; only clear bits are
flipped, which finds every pair once with half the probes.  Complete distances
are verified in the join, over distinct fingerprints only, and linked fingerprints
are merged by :mod:`components`.

Many near copies of one text make a dense cluster, with a number of close pairs near
the square of its fingerprints.  Fingerprints one bit apart are therefore merged first:
they agree once that bit is cleared, and no other fingerprint does, so that takes 32
rows for a half that another fingerprint has too.  The multi-index join then only gives pairs of different classes,
reduced to one a pair of classes before they leave a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, held, sliced, written
from palimpsest.llm.components import components

SEED, DISTANCE, SHINGLE = 42, 3, 3


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the shingles' XXH64 bits; zero for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8"
    )
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, fp``: a hash of the text, and the fingerprint's 64 bits as a
    signed long.  One row per input row: null ids and repeated rows stay, null text
    counts as empty, other columns are ignored."""
    bounded_batches(docs.sparkSession)
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held()
        for part in sliced(batches, 1024):
            found = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def neighbours(distinct: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``fp`` exactly one bit apart.

    They share a half, and few fingerprints share one with any other; only these are
    looked up with each bit of the other half cleared.
    """
    halves = _halves(distinct, "fp")
    crowded = halves.groupBy("half", "part").count().filter("count > 1").select("half", "part")
    met = halves.join(crowded, ["half", "part"], "left_semi")
    bits = F.expr("transform(sequence(0, 31), i -> cast(if(half = 0, 32 + i, i) as byte))")
    cleared = met.select("fp", F.explode(bits).alias("bit")).withColumn("rest", F.expr("fp & ~shiftleft(1L, cast(bit as int))"))
    return cleared.groupBy("bit", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("a", "b")


def _halves(distinct: DataFrame, *columns: str) -> DataFrame:
    """Both 32-bit halves of every fingerprint: ``half`` 0 is the lower one."""
    both = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    return distinct.select(*columns, F.posexplode(both).alias("half", "part"))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes, the columns ``fp`` and ``label`` of distinct
    fingerprints, that hold fingerprints at most three bits apart."""
    halves = _halves(distinct, "fp", "label")
    space = F.shiftleft(F.col("half").cast("long"), 32)
    stored = halves.select((space + F.col("part")).alias("key"), F.col("fp").alias("b"), F.col("label").alias("lb"))
    ball = F.expr("filter(transform(sequence(0, 32), i -> if(i = 32, part, part | shiftleft(1L, i))), (k, i) -> i = 32 or k <> part)")
    probes = halves.select("fp", "label", space.alias("space"), "part", F.explode(ball).alias("near")).select(
        (F.col("space") + F.col("near")).alias("key"), F.col("fp").alias("a"), F.col("label").alias("la"), (F.col("near") == F.col("part")).alias("same")
    )
    apart = (F.col("la") != F.col("lb")) & (~F.col("same") | (F.col("a") < F.col("b")))
    close = apart & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    # sizes before explode() mislead the planner: never broadcast either side
    met = probes.join(stored.hint("merge"), (probes["key"] == stored["key"]) & close)
    return met.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per input row.

    The component is the smallest id reachable over links of at most three
    differing bits.  Null text counts as empty; texts without words share the
    fingerprint zero, linked like any other.  A null id never names a component
    unless its component has no other; repeated rows keep one result row each; an
    empty table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, shingle, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, fp, component_id`` of every row."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    near = components(neighbours(first.select("fp")))
    classes = written(first.join(near, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("label")), "classes")
    label = components(links(classes))
    merged = classes.join(label, F.col("label") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "label").alias("component"))
    least = merged.groupBy("component").agg(F.min("first").alias("component_id"))
    named = merged.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "digest", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1 << 20) -> DataFrame:
    """``docs`` with the document of the smallest id of each group; all columns stay.

    The decision is made row by row: a row goes if its group has a smaller id, even
    where another row with its id stays.  Rows that repeat both id and text are one
    document and share its fate.  Of a group with ids, rows without id go; a group
    of rows without ids stays whole.  Texts do not move: the rows that go, known by
    id and text hash, are broadcast while there are at most ``broadcast_rows`` of
    them (24 bytes each), and are joined by sorting beyond that.
    """
    lost = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = written(
        _grouped(docs, shingle, id_col, text_col).filter(lost).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct(), "near-copies"
    )
    found = gone.count()
    gone = F.broadcast(gone) if found <= broadcast_rows else gone.hint("merge")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__digest"))
    return docs.join(gone, same, "left_anti")
