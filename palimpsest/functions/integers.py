"""Decimal 64-bit integers as values: an optional sign and digits, nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 63), (1 << 63) - 1
_FORM = re.compile(rb"[+-]?[0-9]+\Z")


def parse(value: bytes) -> int | None:
    """The integer, or None if the bytes are not one within 64 bits."""
    if not _FORM.match(value):
        return None
    n = int(value)
    return n if LOW <= n <= HIGH else None


def parse_column(value: Column) -> Column:
    """The same for a string column; null where :func:`parse` says None."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
