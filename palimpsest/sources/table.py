"""Sorted table files in the raw layout, as a Spark source and writer.

Blocks of entries ``kind u8, seq u64, key length u32, value length u32, key,
value``, the offsets of every 16th entry, their number and a CRC; then a key filter,
an index with a CRC (``key length u32, last key, last seq u64, offset u64, size
u32`` per block) and a footer of 52 bytes.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession

from palimpsest.config import BLOCK_BYTES, DELETE, RESTART_EVERY
from palimpsest.errors import Corruption, InvalidArgument
from palimpsest.functions import bloom
from palimpsest.shipping import ship

#: The last eight bytes of a file.
MAGIC = b"PALIMPS3"
ENTRY, FOOTER = struct.Struct("<BQII"), struct.Struct("<QQQQQ")
SCHEMA = "file string, key binary, seq long, kind int, value binary"


class TableWriter:
    """Builds one table from entries in key order, newest version first."""

    def __init__(self, block_bytes: int = BLOCK_BYTES, bloom_bits: int = 10):
        self.block_bytes, self.bloom_bits = block_bytes, bloom_bits
        self.body, self.index, self.keys, self.count = bytearray(), [], [], 0
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, None

    def add(self, key: bytes, seq: int, value: bytes | None) -> None:
        here = (key, -seq)
        if self.last is not None and here <= self.last:
            raise InvalidArgument("entries must be in key order, newest first")
        if self.last is None or key != self.last[0]:
            self.keys.append(key)
        self.last = here
        if self.entries % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        data = value if value is not None else b""
        self.block += ENTRY.pack(1 if value is not None else 2, seq, len(key), len(data)) + key + data
        self.entries += 1
        self.count += 1
        if len(self.block) >= self.block_bytes:
            self._cut()

    def _cut(self) -> None:
        if not self.entries:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        raw += struct.pack("<I", zlib.crc32(raw))
        self.index.append((self.last[0], -self.last[1], len(self.body), len(raw)))
        self.body += raw
        self.block, self.restarts, self.entries = bytearray(), [], 0

    def finish(self) -> bytes:
        self._cut()
        filter_ = bloom.build(self.keys, self.bloom_bits) if self.bloom_bits and self.keys else b""
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QQI", seq, at, size) for k, seq, at, size in self.index)
        index += struct.pack("<I", zlib.crc32(index))
        at = len(self.body)
        head = FOOTER.pack(at + len(filter_), len(index), at, len(filter_), self.count)
        return bytes(self.body) + filter_ + index + head + struct.pack("<I", zlib.crc32(head + MAGIC)) + MAGIC


class Table:
    """A checked table file."""

    def __init__(self, data: bytes):
        if len(data) < 52 or data[-8:] != MAGIC:
            raise Corruption("not a table, or cut short")
        head = data[-52:-12]
        if struct.unpack("<I", data[-12:-8])[0] != zlib.crc32(head + MAGIC):
            raise Corruption("footer checksum mismatch")
        index_at, index_len, filter_at, filter_len, self.count = FOOTER.unpack(head)
        if filter_at + filter_len != index_at or index_at + index_len + 52 != len(data) or index_len < 4:
            raise Corruption("regions do not fill the file")
        index = data[index_at : index_at + index_len]
        if struct.unpack("<I", index[-4:])[0] != zlib.crc32(index[:-4]):
            raise Corruption("index checksum mismatch")
        self.data, self.filter = data, data[filter_at : filter_at + filter_len]
        if self.filter:
            bloom.test(self.filter, [b""])
        self.blocks, at, expect = [], 0, 0
        while at < index_len - 4:
            (n,) = struct.unpack_from("<I", index, at)
            if at + 24 + n > index_len - 4:
                raise Corruption("index entry cut short")
            key = index[at + 4 : at + 4 + n]
            seq, offset, size = struct.unpack_from("<QQI", index, at + 4 + n)
            if offset != expect or (self.blocks and (key, -seq) <= self.blocks[-1][0]):
                raise Corruption("index out of order")
            self.blocks.append(((key, -seq), offset, size))
            expect, at = offset + size, at + 24 + n
        if expect != filter_at:
            raise Corruption("blocks do not fill their region")

    def block(self, n: int) -> list[tuple[bytes, int, bytes | None]]:
        _, offset, size = self.blocks[n]
        raw = self.data[offset : offset + size]
        if size < 8 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise Corruption("block checksum mismatch")
        (restarts,) = struct.unpack("<I", raw[-8:-4])
        end = size - 8 - 4 * restarts
        if end < 0:
            raise Corruption("bad restart count")
        out, at, starts = [], 0, []
        while at < end:
            if len(out) % RESTART_EVERY == 0:
                starts.append(at)
            if at + ENTRY.size > end:
                raise Corruption("entry cut short")
            kind, seq, klen, vlen = ENTRY.unpack_from(raw, at)
            body = at + ENTRY.size
            if body + klen + vlen > end or kind not in (1, DELETE) or (kind == DELETE and vlen):
                raise Corruption("bad entry")
            out.append((raw[body : body + klen], seq, raw[body + klen : body + klen + vlen] if kind == 1 else None))
            at = body + klen + vlen
        if list(struct.unpack(f"<{restarts}I", raw[end : end + 4 * restarts])) != starts:
            raise Corruption("restart points do not match entries")
        return out

    def entries(self):
        n = 0
        for k in range(len(self.blocks)):
            for e in self.block(k):
                n += 1
                yield e
        if n != self.count:
            raise Corruption("entry count does not match the footer")

    def may_hold(self, key: bytes) -> bool:
        return not self.filter or bool(bloom.test(self.filter, [key])[0])

    def get(self, key: bytes, at: int) -> tuple[int, bytes | None] | None:
        """Newest version of the key at or below ``at``: filter, index, one block."""
        from bisect import bisect_left

        if not self.may_hold(key):
            return None
        n = bisect_left(self.blocks, (key, -at), key=lambda b: b[0])
        for k, seq, value in self.block(n) if n < len(self.blocks) else []:
            if k == key and seq <= at:
                return seq, value
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the table files under ``path``, block by block."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                table = Table(bytes(content))
                for n in range(len(table.blocks)):
                    yield pd.DataFrame([(name, k, s, 1 if v is not None else 2, v) for k, s, v in table.block(n)], columns=["file", "key", "seq", "kind", "value"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def files(history: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES, bloom_bits: int = 10) -> DataFrame:
    """Table files of a history: ``part, content``, disjoint key ranges in key order."""
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        writer = TableWriter(block_bytes, bloom_bits)
        for pdf in batches:
            for key, seq, kind, value in zip(pdf["key"], pdf["seq"], pdf["kind"], pdf["value"], strict=True):
                writer.add(bytes(key), int(seq), bytes(value) if kind == 1 else None)
        if writer.count:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [writer.finish()]})

    ship(history.sparkSession)
    rows = history.select(F.col("key").cast("binary").alias("key"), "seq", F.col("kind").cast("int").alias("kind"), F.col("value").cast("binary").alias("value"))
    return rows.repartitionByRange(parts, "key").sortWithinPartitions("key", F.desc("seq")).mapInPandas(run, "part int, content binary")


def lookup(spark: SparkSession, path: str, keys: list[bytes], at: int) -> DataFrame:
    """What a get of each key up to ``at`` finds in each table file under ``path``:
    ``file, key, seq, kind, value``, rows only where it finds a version.

    A file is read by filter, index and one block a key; the keys are one request.
    """
    wanted = sorted(set(map(bytes, keys)))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                table = Table(bytes(content))
                rows = [(name, k, found[0], 1 if found[1] is not None else 2, found[1]) for k in wanted if (found := table.get(k, at)) is not None]
                yield pd.DataFrame(rows, columns=["file", "key", "seq", "kind", "value"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
