"""BPE encoding with reuse of content-defined chunks.

Whole texts are cut where a rolling hash of the last 32 bytes says so, so equal
passages give equal chunks wherever they stand.  Documents are first ordered by the
smallest hash of their lines, so that copies and near copies follow one another in
a task; there every chunk is encoded once and found in a small memo afterwards.
Encoding chunks one by one is wrong around the cuts.  Each join is therefore
repaired: a window around it is encoded again and widened, to the whole text if
need be, until on both sides it agrees with the chunks' own ids over a whole word.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, held, sliced
from palimpsest.llm.tokens import ByteRanks

WINDOW = 32
#: Mean, least and greatest chunk length in bytes.
MEAN, LEAST, MOST = 512, 64, 4096
#: Bytes hashed at a time: bounds the working memory, whatever a text's length.
BLOCK = 1 << 18
#: Words each side of a join's first window.
WORDS = 2
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def _gear():
    """256 fixed pseudo-random 64-bit numbers; zero bytes weigh nothing."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x[0] = 0
    return x


def _marks(joined, gear):
    """Places in a byte array before which the rolling hash of 32 bytes cuts."""
    import numpy as np

    found = []
    for at in range(0, len(joined), BLOCK):
        lead = min(at, WINDOW - 1)
        h = gear[joined[at - lead : at + BLOCK + 1]]
        span = 1
        while span < WINDOW:  # sum of gear[b[i - j]] << j over the window, by doubling
            h[span:] += h[:-span] << np.uint64(span)  # the right side is computed first
            span *= 2
        found.append(np.flatnonzero((h[lead:-1] >> np.uint64(24)) % np.uint64(MEAN) == 0) + at + 1)
    marks = np.concatenate(found)
    return marks[(joined[np.minimum(marks, len(joined) - 1)] & 0xC0) != 0x80]


def chunk(texts: list[bytes], gear=None) -> list[list[bytes]]:
    """Content-defined chunks of every text; cuts fall between characters.

    A chunk with too few words to repair a join in belongs to the one before it
    (the first one to the next), so a run without blanks is one chunk.
    """
    import numpy as np

    gear = _gear() if gear is None else gear
    apart = b"\0" * WINDOW  # keeps one text's bytes out of the next one's hash
    marks = _marks(np.frombuffer(apart.join(texts) + apart, dtype=np.uint8), gear)
    out, at = [], 0
    for text in texts:
        end = at + len(text)
        own = marks[np.searchsorted(marks, at, "right") : np.searchsorted(marks, end, "left")].tolist()
        cuts, last = [], at
        for m in (*own, end):
            while m - last > MOST:  # no mark for long: cut at the next character start
                last += MOST
                while text[last - at] & 0xC0 == 0x80:
                    last -= 1
                cuts.append(last)
            if m - last >= LEAST and m < end:
                cuts.append(m)
                last = m
        edges = [0]
        for c in cuts:
            c -= at
            if _blanks_on(text[edges[-1] : c], WORDS + 1) < c - edges[-1]:
                edges.append(c)
        while len(edges) > 1 and _blanks_on(text[edges[-1] :], WORDS + 1) == len(text) - edges[-1]:
            edges.pop()
        edges.append(len(text))
        out.append([text[i:j] for i, j in zip(edges, edges[1:], strict=False) if j > i])
        at = end + WINDOW
    return out


def _plain(byte: int) -> bool:
    return 0x21 <= byte <= 0x7E


def _blanks_back(text: bytes, end: int, count: int) -> int:
    """The ``count``-th last blank before ``end`` between two plain characters, or 0."""
    p = end
    while count:
        p = text.rfind(b" ", 1, p)
        if p < 0:
            return 0
        count -= p + 1 < end and _plain(text[p - 1]) and _plain(text[p + 1])
    return p


def _blanks_on(text: bytes, count: int) -> int:
    """The ``count``-th blank between two plain characters, or the length."""
    p = 0
    while count:
        p = text.find(b" ", p + 1)
        if p < 0 or p + 1 >= len(text):
            return len(text)
        count -= _plain(text[p - 1]) and _plain(text[p + 1])
    return p


class ChunkEncoder:
    """Texts to ids by chunk reuse, and ids back to text."""

    def __init__(self, path: str, memo_bytes: int = 32 << 20):
        self.ranks, self.memo_bytes, self.gear = ByteRanks(path), memo_bytes, _gear()
        self.memo: dict[bytes, array] = {}
        self.held = self.encoded = self.reused = self.widened = 0
        self.bytes = self.ranks.bytes
        self.width = [len(b) for b in self.bytes]

    def _whole(self, pieces: list[bytes]) -> list[array]:
        """The ids of each piece, encoded as one text."""
        return list(map(self.ranks.encode, pieces))

    def _tokens_back(self, ids: array, size: int) -> int | None:
        """How many of the last ids make exactly ``size`` bytes."""
        n, width = 0, self.width
        while size > 0:
            n += 1
            size -= width[ids[-n]]
        return n if size == 0 else None

    def _tokens_on(self, ids: array, size: int) -> int | None:
        n, width = 0, self.width
        while size > 0:
            size -= width[ids[n]]
            n += 1
        return n if size == 0 else None

    def _join(self, text: bytes, at: int, ids: array, right: bytes, own: array, first: dict[bytes, array]) -> None:
        """Append ``right`` to the ids of ``text[:at]``, repairing the join.

        A window that has grown to all of ``text[:at]`` and ``right`` agrees.
        """
        words = WORDS
        while True:
            a, b = _blanks_back(text, at, words), _blanks_on(right, words)
            window = text[a : at + b]
            new = first.get(window) or self._whole([window])[0]
            drop, skip = self._tokens_back(ids, at - a), self._tokens_on(own, b)
            if drop is not None and skip is not None:
                # the outermost word on each side must have kept its ids
                lead = self._tokens_on(new, _blanks_back(text, at, words - 1) - a) if a else 0
                trail = self._tokens_back(new, b - _blanks_on(right, words - 1)) if b < len(right) else 0
                left_agrees = a == 0 or (lead and new[:lead] == ids[len(ids) - drop :][:lead])
                right_agrees = b == len(right) or (trail and new[len(new) - trail :] == own[skip - trail : skip])
                if left_agrees and right_agrees:
                    if drop:
                        del ids[len(ids) - drop :]
                    ids.extend(new)
                    ids.extend(own[skip:])
                    return
            self.widened += 1
            words *= 2

    def encode(self, texts: list[bytes]) -> list[array]:
        chunked, memo = chunk(texts, self.gear), self.memo
        uses = dict.fromkeys(c for chunks in chunked for c in chunks)
        missing = [c for c in uses if c not in memo]
        known = dict(zip(missing, self._whole(missing), strict=True))
        self.encoded += len(missing)
        self.reused += sum(map(len, chunked)) - len(missing)
        known |= {c: memo[c] for c in uses if c not in known}
        windows = dict.fromkeys(
            a[_blanks_back(a, len(a), WORDS) :] + b[: _blanks_on(b, WORDS)] for chunks in chunked for a, b in zip(chunks, chunks[1:], strict=False)
        )
        first = dict(zip(windows, self._whole(list(windows)), strict=True))
        out = []
        for text, chunks in zip(texts, chunked, strict=True):
            ids, at = array("I"), 0
            for k, c in enumerate(chunks):
                if k == 0:
                    ids.extend(known[c])
                else:
                    self._join(text, at, ids, c, known[c], first)
                at += len(c)
            out.append(ids)
        # what came last is met again soonest: an old memo gives way as a whole
        self.held += sum(len(c) + 4 * len(known[c]) + 200 for c in missing)
        if self.held > self.memo_bytes:
            memo.clear()
            self.held = 0
            known = {c: known[c] for c in chunked[-1]} if chunked else {}
            self.held = sum(len(c) + 4 * len(x) + 200 for c, x in known.items())
        memo.update(known)
        return out

    def decode(self, ids: array) -> str:
        """As the library's ``decode`` with special tokens kept."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers, equal to the library's for
    the whole text.  Null text counts as empty: no ids.  Null ids, repeated rows
    and ids keep one result row each; an empty table gives an empty result; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    near = F.array_min(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda line: F.xxhash64(line)))
    together = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), near.alias("near"))
        .repartitionByRange("near", "doc_id")  # the id splits large groups of copies
        .sortWithinPartitions("near")
        .select("doc_id", "text")
    )

    def run(batches):
        import pyarrow as pa

        enc = held(f"chunks {tokenizer_path}", lambda: ChunkEncoder(tokenizer_path))
        for part in sliced(batches, 256, text=1):
            found = enc.encode([t.encode() for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                    pa.array([enc.decode(x) for x in found], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return together.mapInArrow(run, SCHEMA)
