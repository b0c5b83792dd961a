"""Encoding whole texts with the tokenizers library, remembering frequent pieces.

A text is cut at single blanks or line breaks that stand between two other
characters.  Both public vocabularies used here always start a new pre-token at
such a place, whatever surrounds it, so the ids of a text are those of its pieces
put one after the other.  Every piece is encoded by the library; pieces seen
before come from a bounded memo, as most words of a corpus repeat.
"""

from __future__ import annotations

import os
import re
from array import array

from palimpsest.llm.common import held

#: A run of other characters with at most one blank or line break before it.
#: Any other white space stays inside a piece, together with its neighbours.
PIECE = re.compile(r"(?:\A\s+|[ \n])?\S+(?:(?:\s\s+|[^\S \n])\S+)*(?:\s+\Z)?|\A\s+\Z")

#: Pieces a worker remembers at most (about 250 MB).
MEMO = 1_400_000
#: Joins pieces for the library: a control character no white-space run touches.
MARK = " \x01"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a vocabulary file, without padding or truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _holes(known: list) -> list[int]:
    """Places of None, found without a step per place."""
    out, at = [], -1
    for _ in range(known.count(None)):
        at = known.index(None, at + 1)
        out.append(at)
    return out


def _whole(pieces) -> bool:
    """Whether a quick cut gave pieces that stand alone (no white space runs)."""
    return all([(core := p.strip()) and len(p) - len(core) == (p[0] in " \n") for p in pieces])


class PieceEncoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers.

    ``limit`` bounds the memo and ``longest`` the pieces that are remembered;
    neither changes a result.  A full memo takes no more pieces, as the frequent
    ones come early; once as many again were missed, it starts afresh.
    """

    def __init__(self, path: str, limit: int = MEMO, longest: int = 48):
        self.tokenizer, self.limit, self.longest = load(path), limit, longest
        self.memo: dict[str, bytes] = {"": b""}
        self.missed = 0
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # the memo is the cache; the library's only costs time
        normal = self.tokenizer.normalizer
        self.folds = normal is not None and normal.normalize_str("Ab") == "ab"
        self.mark = array("I", self.tokenizer.encode(MARK, add_special_tokens=False).ids)

    def library(self, texts: list[str]) -> list[bytes]:
        """What the library says, text by text."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that open with a blank or line break and stand alone.

        They are joined by a mark that occurs in none of them, as one long text
        costs the library less than many short ones, and the ids are cut at it.
        """
        import numpy as np

        found: dict[str, bytes] = {}
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            packed = self.library([MARK.join(part) + MARK])[0]
            ends = ((np.flatnonzero(np.frombuffer(packed, "<u4") == self.mark[-1]) + 1) * 4).tolist()
            size = 4 * len(self.mark)
            found.update((p, packed[i : j - size]) for p, i, j in zip(part, [0, *ends[:-1]], ends, strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get, cut, plain, odd = self.memo.get, [], {}, {}
        for text in texts:
            text = text or ""
            if self.folds and text.isascii() and "<|" not in text:  # the library would do so anyway
                text = text.lower()
            pieces = [] if MARK[-1] in text or "\0" in text else text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            known = list(map(get, pieces))
            holes = _holes(known)
            new = [pieces[k] for k in holes]
            if not pieces or not _whole(new):  # runs of white space: the careful cut
                pieces = PIECE.findall(text)
                known = list(map(get, pieces))
                holes = _holes(known)
                new = [pieces[k] for k in holes]
                odd.update(dict.fromkeys(new))
            else:
                plain.update(dict.fromkeys(new))
            cut.append((known, holes, new))
        first = [p for p in plain if p[0] not in " \n"]
        missing = self._joined([p for p in plain if p[0] in " \n"]) | dict(zip(first, self.library(first), strict=True))
        kept = {p: ids for p, ids in missing.items() if len(p) <= self.longest}
        alone = [p for p in odd if p not in missing]
        missing |= dict(zip(alone, self.library(alone), strict=True))
        out = []
        for known, holes, new in cut:
            for k, p in zip(holes, new, strict=True):
                known[k] = missing[p]
            out.append(b"".join(known))
        if len(self.memo) + len(kept) <= self.limit:
            self.memo.update(kept)
        elif (missed := self.missed + len(kept)) > self.limit:
            self.memo, self.missed = {"": b""}, 0
        else:
            self.missed = missed
        return out


def encoder(path: str, limit: int = MEMO) -> PieceEncoder:
    """This worker's encoder of a vocabulary; its memo outlives a task."""
    return held(f"pieces {path}", lambda: PieceEncoder(path, limit))


#: How the byte-level vocabulary cuts a text into words (fixed value of its file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes, in order,
    for the characters from U+0100 on.
    """
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class ByteRanks:
    """A byte-level vocabulary file, encoded by merge ranks: the tokenizers library's
    ids at a third of its time and without a memo.

    Only files whose ids follow the order of their merges can be read so.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, cut = file["model"]["vocab"], file["pre_tokenizer"]
        if file["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        back = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(map(back.__getitem__, t)): k for t, k in vocab.items() if t not in special}
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in file["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("ids do not follow the order of the merges")
        self.special = list(special)
        self.coder = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for b, k in (ranks | {t.encode(): k for t, k in special.items()}).items():
            self.bytes[k] = b

    def encode(self, text: bytes) -> array:
        """The ids of one text in UTF-8; special tokens are found as the library finds them."""
        t = text.decode()
        if any(x in t for x in self.special):
            return array("I", self.coder.encode(t, allowed_special="all", disallowed_special=()))
        return array("I", self.coder.encode_ordinary(t))
