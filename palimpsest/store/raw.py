"""Raw directories (a manifest, table files, write-ahead logs) into a store and back."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import FORMATS, PUT, Options
from palimpsest.errors import Corruption, InvalidArgument
from palimpsest.operators.files import live_files
from palimpsest.shipping import ship
from palimpsest.sources import manifest, table, wal
from palimpsest.store.log import Files
from palimpsest.store.store import Store

MANIFEST = "MANIFEST"
_NUMBERED = re.compile(r"([0-9]+)\.(log|sst)$")


def _log_ends(spark: SparkSession, paths: list[str]) -> dict[int, tuple[int, int, int]]:
    """Of every log its length, the length of its whole records, and its last number."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                versions, used = wal.replay(bytes(content))
                rows.append((path, len(content), used, max((v[1] for v in versions), default=0)))
            yield pd.DataFrame(rows, columns=["path", "size", "used", "last"])

    ship(spark)
    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, size long, used long, last long").collect()  # one row per log
    return defaultdict(lambda: (0, 0, 0), {int(_NUMBERED.search(r["path"]).group(1)): (r["size"], r["used"], r["last"]) for r in found})  # empty files are not read


def recover(spark: SparkSession, folder: str, path: str, options: Options | None = None) -> Store:
    """A new store at ``path`` with what the raw directory ``folder`` durably holds.

    The manifest says which tables are live, at which level, and from which number on
    logs count.  Every live table must be there and whole; other tables, older logs and
    temporary files are left alone.  Logs are replayed oldest first.  Only the newest
    may end in the torn record of a crash, which is cut off; a torn older one is
    corruption.  The last sequence number is the greater of the manifest's and the
    logs'.  The raw directory is not changed.
    """
    raw = Files(spark, folder.rstrip("/"))
    names = raw.list("")
    if MANIFEST not in names:
        raise InvalidArgument(f"{folder} has no {MANIFEST}")
    edits = manifest.replay(raw.read(MANIFEST))
    rows = [(pos, op, value, level) for pos, op, value, level in edits]
    alive = live_files(spark.createDataFrame(rows, "pos long, op string, id long, level int")).collect() if rows else []
    number = max((v for _, op, v, _ in edits if op == "LOGNUM"), default=0)
    last_seq = max((v for _, op, v, _ in edits if op == "LASTSEQ"), default=0)
    if any(op == "FORMAT" and v not in FORMATS for _, op, v, _ in edits):
        raise Corruption("unknown format")
    found = {(int(m.group(1)), m.group(2)): n for n in names if (m := _NUMBERED.search(n))}
    if lost := [r["id"] for r in alive if (r["id"], "sst") not in found]:
        raise Corruption(f"table {lost[0]} is missing")
    store = Store(spark, path, options)
    if store.state.files or store.state.last_seq:
        raise InvalidArgument(f"{path} is not empty")
    made: list[dict] = []
    if alive:
        by_path = {found[r["id"], "sst"]: r for r in alive}
        rows = table.read(spark, [f"{raw.root}/{n}" for n in by_path]).withColumn("_file", F.regexp_extract("file", r"([0-9]+)\.sst$", 1).cast("long"))
        staging = f"data/raw-{uuid.uuid4().hex[:12]}"
        cols = ["key", "seq", F.col("kind").cast("byte").alias("kind"), "value", "_file"]
        store._writer(rows.select(*cols).repartition("_file").sortWithinPartitions("_file", "key", F.desc("seq"))).partitionBy("_file").parquet(f"{store.path}/{staging}")
        made = store._describe({str(r["id"]): (r["id"], r["level"]) for r in alive}, staging, "_file")
    logs = sorted(n for n, kind in found if kind == "log" and n >= number)
    if logs:
        paths = [f"{raw.root}/{found[n, 'log']}" for n in logs]
        ends = _log_ends(spark, paths)
        for n in logs[:-1]:
            if ends[n][1] != ends[n][0]:
                raise Corruption(f"log {n} is torn, and newer logs follow it")
        last_seq = max([last_seq, *(ends[n][2] for n in logs)])
        if any(ends[n][2] for n in logs):
            store.state.next_id = max([store.state.next_id, *(f["id"] + 1 for f in made)])
            versions = wal.read(spark, paths).select("key", "seq", F.col("kind").cast("byte").alias("kind"), "value")
            made.append(store._write_file(versions, 0))
    store._append([{"op": "ADD", "file": f} for f in made] + [{"op": "LASTSEQ", "id": last_seq}, {"op": "LOGNUM", "id": max([number, *logs])}], {})
    store._check_levels()
    return store


def dump(store: Store, folder: str) -> None:
    """Write a store's state as a raw directory: one table per live file, the unflushed
    versions as a log, and a manifest."""
    raw = Files(store.spark, folder.rstrip("/"))
    with store.lock:
        state = store.state
        edits: list[tuple[str, int, int | None]] = [("FORMAT", FORMATS[-1], None)]
        for f in sorted(state.files.values(), key=lambda f: f["id"]):
            rows = store.spark.read.schema("key binary, seq long, kind byte, value binary").parquet(f"{store.path}/{f['path']}")
            for r in table.files(rows, 1, bloom_bits=store.options.bloom_bits_per_key).toLocalIterator():  # one table
                raw.write(f"{f['id']:06d}.sst", bytes(r["content"]))
            edits.append(("ADD", f["id"], f["level"]))
        number = max([0, *state.files]) + 1
        records = [wal.encode(seq, [(kind, key, value)]) for seq, kind, key, value in state.memtable.operations()]
        raw.write(f"{number:06d}.log", b"".join(records))
        edits += [("LOGNUM", number, None), ("LASTSEQ", state.last_seq, None)]
        raw.write(MANIFEST, manifest.encode(edits[:1]) + manifest.encode(edits[1:]))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the table files under ``path`` as text, checked on the way."""
    rows = table.read(spark, path)
    return rows.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "key", "seq", F.when(F.col("kind") == PUT, "put").otherwise("delete").alias("kind"), "value")
