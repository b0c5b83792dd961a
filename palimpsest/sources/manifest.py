"""Manifest files in the raw layout: 13-byte records ``crc32 u32, tag u8, value u64``."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import FORMATS, LEVELS
from palimpsest.errors import Corruption, InvalidArgument
from palimpsest.shipping import ship
from palimpsest.staging import settled

# Fixed values of the layout: tags of the edits; 0x10 + level adds a table.
TAGS = {"REMOVE": 2, "LOGNUM": 3, "FORMAT": 4, "LASTSEQ": 5, "GROUP": 6}
ADD, MAX_GROUP, RECORD = 0x10, 1 << 16, struct.Struct("<BQ")
_NAMES = {v: k for k, v in TAGS.items()}
LAYOUT = np.dtype([("crc", "<u4"), ("tag", "u1"), ("value", "<u8")])
#: Records worked on at a time.
BLOCK = 1 << 16


def encode(edits: list[tuple[str, int, int | None]]) -> bytes:
    """One commit of edits ``(op, id, level)``; several get a group header."""
    head = [("GROUP", len(edits), None)] if len(edits) > 1 else []
    out = b""
    for op, value, level in head + list(edits):
        body = RECORD.pack(ADD + level if op == "ADD" else TAGS[op], value)
        out += struct.pack("<I", zlib.crc32(body)) + body
    return out


@cache
def _crc_tables() -> tuple[np.ndarray, int]:
    """What each byte at each place of a record's body adds to the CRC, and the CRC of zeros."""
    none = zlib.crc32(bytes(RECORD.size))
    single = [[bytes(i) + bytes([b]) + bytes(RECORD.size - 1 - i) for b in range(256)] for i in range(RECORD.size)]
    return np.array([[zlib.crc32(body) ^ none for body in row] for row in single], np.uint32), none


def _crcs(records: np.ndarray) -> np.ndarray:
    """The CRCs of many records: of one length, so they are sums of their bytes' parts."""
    tables, none = _crc_tables()
    out = np.full(len(records), none, np.uint32)
    for at in range(0, len(records), BLOCK):
        body = records[at : at + BLOCK].view(np.uint8).reshape(-1, LAYOUT.itemsize)[:, 4:]
        for i in range(RECORD.size):
            out[at : at + BLOCK] ^= tables[i][body[:, i]]
    return out


def _commits(tags: np.ndarray, values: np.ndarray, per_group: int) -> bytes:
    """Edits as :func:`encode` has them, in commits of ``per_group``."""
    first = np.arange(0, len(tags), per_group)
    sizes = np.minimum(per_group, len(tags) - first)
    first, sizes = first[sizes > 1], sizes[sizes > 1]
    records = np.empty(len(tags) + len(first), LAYOUT)
    records["tag"], records["value"] = np.insert(tags, first, TAGS["GROUP"]), np.insert(values, first, sizes)
    records["crc"] = _crcs(records)
    return records.tobytes()


def pieces(edits: DataFrame, per_group: int = 100) -> Iterator[bytes]:
    """A manifest of the edits ``pos, op, id, level``, piece by piece.

    Executors sort ranges of ``pos`` and encode them in commits of at most ``per_group``
    edits; the driver holds a few pieces at a time.
    """
    if not 1 <= per_group <= MAX_GROUP:
        raise InvalidArgument(f"a group holds 1 to {MAX_GROUP} edits")
    tag = F.when((F.col("op") == "ADD") & F.col("level").between(0, LEVELS - 1), F.lit(ADD) + F.col("level"))
    for op, number in TAGS.items():
        if op != "GROUP":
            tag = tag.when(F.col("op") == op, F.lit(number))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("tag").null_count or batch.column("id").null_count or (values := batch.column("id").to_numpy()).min() < 0:
                raise InvalidArgument("an edit that no manifest can hold")
            yield pa.RecordBatch.from_arrays([pa.array([_commits(batch.column("tag").to_numpy(), values, per_group)], pa.binary())], ["piece"])

    ship(edits.sparkSession)
    yield encode([("FORMAT", FORMATS[-1], None)])
    rows = edits.select("pos", tag.cast("int").alias("tag"), F.col("id").cast("long").alias("id")).repartitionByRange("pos").sortWithinPartitions("pos")
    for r in settled(rows.select("tag", "id").mapInArrow(run, "piece binary")).toLocalIterator():
        yield bytes(r["piece"])


def _columns(data) -> tuple[np.ndarray, np.ndarray]:
    """Tags and values of the edits, without group headers; a torn last commit is left out whole."""
    raw = np.frombuffer(data, np.uint8)
    used = len(raw)  # up to the last byte that is not zero
    while used and not raw[max(0, used - BLOCK) : used].any():
        used = max(0, used - BLOCK)
    if used:
        start = max(0, used - BLOCK)
        used = start + int(np.flatnonzero(raw[start:used])[-1]) + 1
    size = LAYOUT.itemsize
    records = raw[: min(len(raw) // size, -(-used // size)) * size].view(LAYOUT)
    tags = records["tag"].copy()
    known = np.zeros(256, bool)
    known[[*range(ADD, ADD + LEVELS), *_NAMES]] = True
    whole = records["crc"] == _crcs(records)
    wrong = np.flatnonzero(~(whole & known[tags]))
    if len(wrong):
        k = int(wrong[0])
        if whole[k]:
            raise Corruption(f"unknown manifest tag {tags[k]}")
        if used > (k + 1) * size:
            raise Corruption(f"bad manifest record at byte {k * size} with more data after it")
        records, tags = records[:k], tags[:k]
    if len(tags) and tags[0] != TAGS["FORMAT"]:
        raise Corruption("a manifest must begin with a format record")
    values = records["value"].copy()
    heads = np.flatnonzero(tags == TAGS["GROUP"])
    sizes = values[heads]
    if ((sizes < 1) | (sizes > MAX_GROUP)).any():
        raise Corruption("bad group")
    ends = heads + sizes.astype(np.int64)
    if (heads[1:] <= ends[:-1]).any():
        raise Corruption("bad group")
    if len(heads) and ends[-1] >= len(tags):
        tags, values = tags[: heads[-1]], values[: heads[-1]]
    kept = tags != TAGS["GROUP"]
    return tags[kept], values[kept]


def replay(data: bytes) -> list[tuple[int, str, int, int | None]]:
    """Edits ``(pos, op, id, level)``; a torn last commit is left out whole."""
    tags, values = _columns(data)
    return [(pos, *(("ADD", value, tag - ADD) if tag >= ADD else (_NAMES[tag], value, None))) for pos, (tag, value) in enumerate(zip(tags.tolist(), values.tolist(), strict=True))]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Edits of manifest files: ``pos, op, id, level``; one task per file."""

    def run(batches):
        import pyarrow as pa

        names = pa.array([_NAMES.get(tag, "ADD") for tag in range(ADD + 1)])
        for batch in batches:
            for content in batch.column("content"):
                tags, values = _columns(content.as_buffer())
                for at in range(0, len(tags), BLOCK):
                    tag, value = tags[at : at + BLOCK], values[at : at + BLOCK]
                    ids = pa.array(value, pa.uint64()).cast(pa.int64())  # an error beyond 63 bits
                    level = pa.array(tag.astype(np.int32) - ADD, pa.int32(), mask=tag < ADD)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(tag))), names.take(pa.array(np.minimum(tag, ADD))), ids, level], ["pos", "op", "id", "level"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos long, op string, id long, level int")
