"""Token files with directly addressable codes.

Ids are split into bytes.  Level 0 holds the lowest byte of every id, level 1 the
next byte of the ids that need one, and so on.  A bitmap per level says which ids
go on, and a rank directory (ones before every 512th bit) turns a position in one
level into the position in the next, so that any token is read with one lookup
per level and no block is decoded.

A file ("shard") is one binary value: a header, the documents' ids and starts, and
the levels.  Shards are rows of a table in the shared folder, written and read by
Spark, so the same code works on every file system Spark knows.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, sliced, written
from palimpsest.llm.tokens import encoder

MAGIC = b"DACTOKN1"
RANK_BITS = 512
SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, file binary"
DOC_SCHEMA = "doc_id long, part int, shard int, local_start long, n_tokens long, ids binary"


def build(doc_ids: list[int | None], lengths: list[int], packed: bytes) -> bytes:
    """One shard from its documents' ids, token counts and joined token ids."""
    import numpy as np

    ids = np.frombuffer(packed, dtype="<u4")
    starts = np.zeros(len(lengths) + 1, dtype="<u8")
    np.cumsum(lengths, out=starts[1:])
    known = np.array([x is not None for x in doc_ids], dtype="u1")
    names = np.array([x or 0 for x in doc_ids], dtype="<i8")
    levels = []
    while True:
        more = ids > 0xFF
        ranks = np.zeros(len(ids) // RANK_BITS + 1, dtype="<u8")
        whole = len(ids) // RANK_BITS * RANK_BITS
        np.cumsum(more[:whole].reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64), out=ranks[1:])
        levels.append((len(ids), np.packbits(more, bitorder="little").tobytes(), ranks.tobytes(), (ids & 0xFF).astype("u1").tobytes()))
        ids = ids[more] >> 8
        if not len(ids):
            break
    head = struct.pack("<8sQI", MAGIC, len(doc_ids), len(levels)) + names.tobytes() + known.tobytes() + starts.tobytes()
    return head + b"".join(struct.pack("<Q", n) + bits + ranks + data for n, bits, ranks, data in levels)


class Shard:
    """Random access to the tokens of one shard."""

    def __init__(self, file: bytes):
        import numpy as np

        magic, docs, levels = struct.unpack_from("<8sQI", file)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<8sQI")
        self.doc_ids = np.frombuffer(file, "<i8", docs, at)
        self.known = np.frombuffer(file, "u1", docs, at := at + 8 * docs)
        self.starts = np.frombuffer(file, "<u8", docs + 1, at := at + docs)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", file, at)
            bits = np.frombuffer(file, "u1", -(-n // 8), at := at + 8)
            ranks = np.frombuffer(file, "<u8", n // RANK_BITS + 1, at := at + len(bits))
            data = np.frombuffer(file, "u1", n, at := at + 8 * len(ranks))
            at += n
            self.levels.append((bits, ranks, data))

    def _rank(self, level: int, i: int) -> int:
        """Ids before position ``i`` of a level that go on to the next one."""
        import numpy as np

        bits, ranks, _ = self.levels[level]
        block = i // RANK_BITS
        inside = np.unpackbits(bits[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(inside[: i - block * RANK_BITS].sum())

    def token(self, i: int) -> int:
        """The ``i``-th token of the shard."""
        value = 0
        for level, (bits, _, data) in enumerate(self.levels):
            value |= int(data[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, stop: int):
        """Tokens ``start`` to ``stop`` as an unsigned 32-bit array."""
        import numpy as np

        parts = []
        for level, (bits, _, data) in enumerate(self.levels):
            if start == stop:
                break
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - first * 8 : stop - first * 8].astype(bool)
            parts.append((data[start:stop].astype("<u4"), more))
            start = self._rank(level, start)
            stop = start + int(more.sum())
        value = np.zeros(0, dtype="<u4")
        for low, more in reversed(parts):
            low[more] |= value << 8
            value = low
        return value


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every document, append ``end_id`` and write shards by ascending id.

    Returns the written table ``part, shard, n_docs, n_tokens, file``; the order of
    ``(part, shard)`` and of the documents within a shard is that of the ids, null
    ids first, repeated ids by a hash of their text.  Null text counts as empty: the
    end id alone.  Very long texts are encoded whole and lie in one shard.  An empty
    table has no shards; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard, tail, enc = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(4, "little"), encoder(tokenizer_path)
        names: list = []
        lengths: list[int] = []
        packed: list[bytes] = []
        total = 0

        def file():
            rows = [[part], [shard], [len(names)], [total], [build(names, lengths, b"".join(packed))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(rows, kinds, strict=True)], names=["part", "shard", "n_docs", "n_tokens", "file"])

        for piece in sliced(batches):
            for doc_id, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist()), strict=True):
                names.append(doc_id)
                packed.append(ids + tail)
                lengths.append(len(ids) // 4 + 1)
                total += lengths[-1]
            if total >= shard_tokens:
                yield file()
                shard, total = shard + 1, 0
                names, lengths, packed = [], [], []
        if names:
            yield file()

    return written(ordered.mapInArrow(run, SHARD_SCHEMA), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Documents of a table of shards: ``doc_id, part, shard, local_start, n_tokens, ids``.

    One row per document that was written, null and repeated ids included; a table
    without shards gives an empty result; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, shard, file in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Shard(file)
                ends = s.starts.tolist()
                for k in range(0, len(s.doc_ids), 512):
                    docs = range(k, min(k + 512, len(s.doc_ids)))
                    ids = s.tokens(ends[k], ends[docs[-1] + 1]).tobytes()
                    base = ends[k]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(s.doc_ids[n]) if s.known[n] else None for n in docs], pa.int64()),
                            pa.array([part] * len(docs), pa.int32()),
                            pa.array([shard] * len(docs), pa.int32()),
                            pa.array([ends[n] for n in docs], pa.int64()),
                            pa.array([ends[n + 1] - ends[n] for n in docs], pa.int64()),
                            pa.array([ids[(ends[n] - base) * 4 : (ends[n + 1] - base) * 4] for n in docs], pa.binary()),
                        ],
                        names=["doc_id", "part", "shard", "local_start", "n_tokens", "ids"],
                    )

    return shards.select("part", "shard", "file").mapInArrow(run, DOC_SCHEMA)


def with_global_start(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows of :func:`read_tokens`.

    Only one row per shard, not per document, goes through the running sum.
    ``docs`` should hold digests rather than ids, as the join may shuffle it.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select("part", "shard", before.alias("base"))
    return docs.join(bases, ["part", "shard"]).withColumn("start", F.col("local_start") + F.col("base")).drop("part", "shard", "local_start", "base")
