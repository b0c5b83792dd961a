"""Packing documents into sequences by multiway Karmarkar-Karp differencing.

Full windows of a long document become sequences of their own.  The remainders,
cut into pieces of at most ``piece`` tokens, are packed block by block: partial
partitions into ``k`` windows are merged two at a time, the ones with the largest
imbalance first and with opposing order, so that the windows end up nearly equal.
Where a window exceeds the capacity, the block is packed again with more windows.
A block holds a bounded number of tokens of one input partition, so packing needs
no shuffle and its result depends only on the partition's rows and their order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, sliced
from palimpsest.llm.tokens import encoder

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into ``k`` windows of nearly equal total size.

    A partial partition is a list of (size, items) from large to small; windows
    left out are empty.  Items are kept as nested pairs until the end.
    """
    order = iter(range(len(sizes)))
    heap = [(-s, next(order), [(s, n)]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        overlap = len(one) + len(two) - k
        if overlap <= 0:
            merged = one + two
        else:  # the smallest windows of both meet, in opposing order
            a, b = one[len(one) - overlap :], two[len(two) - overlap :]
            merged = one[: len(one) - overlap] + two[: len(two) - overlap]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    windows: list[list[int]] = []
    for _, node in heap[0][2] if heap else []:
        flat, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                flat.append(x)
        windows.append(sorted(flat))
    return windows


def windows_for(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows that fit, from the least possible count upward.

    The count starts at what the total needs, or at what the largest pieces need
    as only so many of their size go into a window, and rises by one while the
    largest window exceeds the capacity.
    """
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    for n, size in enumerate(sorted(sizes, reverse=True), 1):
        k = max(k, -(-n // max(1, capacity // size)))
    while True:
        found = difference(sizes, k)
        if max(sum(sizes[n] for n in w) for w in found) <= capacity:
            return found
        k += 1


def cuts(tokens: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """Pieces of one document: full windows, then near-equal parts of the rest."""
    at = 0
    while tokens - at >= capacity:
        yield at, capacity
        at += capacity
    rest = tokens - at
    parts = -(-rest // piece)
    for n in range(parts):
        end = at + rest * (n + 1) // parts
        begin = at + rest * n // parts
        yield begin, end - begin


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = 512,
    block_tokens: int = 1 << 17, memo: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every document, append ``end_id`` and pack all ids into sequences.

    Returns a row per piece: ``doc_id, start, length, ids`` (little-endian
    unsigned 32-bit), ``doc_tokens, sequence_id, offset, sequence_length``.  Null
    text counts as empty: one piece with the end id.  Null ids and repeated rows
    are packed like others; an empty table has no sequences; other columns are
    ignored.  Sequence ids are unique, not consecutive.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tail = int(end_id).to_bytes(4, "little")
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        sequence = TaskContext.get().partitionId() << 40
        enc = encoder(tokenizer_path, memo)
        rows: list[tuple] = []
        held: list[tuple] = []
        total = 0

        def flush():
            nonlocal sequence, held, total
            for window in windows_for([p[2] for p in held], capacity):
                offset, full = 0, sum(held[n][2] for n in window)
                for n in window:
                    rows.append((*held[n], sequence, offset, full))
                    offset += held[n][2]
                sequence += 1
            held, total = [], 0

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for part in sliced(batches):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc_id, packed in zip(ids, enc.encode(texts), strict=True):
                packed += tail
                n = len(packed) // 4
                for at, size in cuts(n, capacity, piece):
                    one = (doc_id, at, size, packed[at * 4 : (at + size) * 4], n)
                    if size == capacity:
                        rows.append((*one, sequence, 0, size))
                        sequence += 1
                    else:
                        held.append(one)
                        total += size
                if total >= block_tokens:
                    flush()
                if len(rows) >= 2000:
                    yield batch()
        flush()
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
