"""Byte globs: ``*`` any run, ``?`` any one byte, ``\\x`` the byte x itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: bytes) -> str:
    """An anchored regex over text in which one character is one byte.

    Runs of stars collapse, and each becomes a reluctant run.  There are no
    classes, and a lone backslash at the end stands for itself.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i : i + 1]
        if c == b"\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i : i + 1].decode("latin-1")))
        elif c == b"*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == b"?":
            out.append(".")
        else:
            out.append(re.escape(c.decode("latin-1")))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def segments(pattern: bytes) -> list[list[int | None]]:
    """The byte runs between stars; None is any one byte."""
    runs: list[list[int | None]] = [[]]
    escaped = False
    for k, c in enumerate(pattern):
        if escaped:
            runs[-1].append(c)
            escaped = False
        elif c == 0x5C and k + 1 < len(pattern):
            escaped = True
        elif c == 0x2A:
            runs.append([])
        else:
            runs[-1].append(None if c == 0x3F else c)
    return runs


def match(pattern: bytes, text: bytes) -> bool:
    """Leftmost placement of each run between stars; linear in practice."""
    runs = segments(pattern)

    def fits(run, at):
        return at >= 0 and at + len(run) <= len(text) and all(r is None or r == text[at + k] for k, r in enumerate(run))

    if len(runs) == 1:
        return len(text) == len(runs[0]) and fits(runs[0], 0)
    if not fits(runs[0], 0):
        return False
    at, end = len(runs[0]), len(text) - len(runs[-1])
    for run in runs[1:-1]:
        while at + len(run) <= end and not fits(run, at):
            at += 1
        if at + len(run) > end:
            return False
        at += len(run)
    return at <= end and fits(runs[-1], end)


def like(key: Column, pattern: bytes | str) -> Column:
    """Whether the byte (or ASCII string) column matches the glob."""
    raw = pattern.encode() if isinstance(pattern, str) else pattern
    return F.decode(key.cast("binary"), "ISO-8859-1").rlike(to_regex(raw))
