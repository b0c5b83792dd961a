"""Wire requests and replies of the line-based protocol.

A reply is a pair of a tag and its content.  Parsing is incremental: it takes the
bytes so far and says how many it used, or that more are needed.
"""

from __future__ import annotations

from palimpsest.errors import ProtocolError
from palimpsest.shipping import ship

# Fixed values of the protocol: limits on one request, and the texts of its errors below.
MAX_BULK, MAX_ARGS, MAX_LINE = 64 << 20, 1 << 20, 64 << 10

NIL, NIL_ARRAY = ("nil", None), ("nil_array", None)


def simple(text: str):
    return ("simple", text)


def error(text: str):
    return ("error", text)


def integer(n: int):
    return ("int", n)


def bulk(data: bytes):
    return ("bulk", data)


def array(items: list):
    return ("array", items)


OK = simple("OK")


class _More(Exception):
    """The request is not complete yet."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def line(self) -> bytes:
        end = self.data.find(b"\n", self.at)
        if (end if end >= 0 else len(self.data)) - self.at > MAX_LINE:
            raise ProtocolError("line too long")
        if end < 0:
            raise _More
        text, self.at = self.data[self.at : end], end + 1
        return text[:-1] if text.endswith(b"\r") else text

    def count(self, text: bytes, most: int, what: str) -> int:
        digits = text[1:] if text.startswith(b"+") else text
        if not digits.isdigit():
            raise ProtocolError(f"invalid {what} '{text.decode('utf-8', 'replace')}'")
        if int(digits) > most:
            raise ProtocolError(f"{what} {int(digits)} is over the limit of {most}")
        return int(digits)

    def take(self, n: int) -> bytes:
        if len(self.data) < self.at + n + 2:
            raise _More
        body, tail = self.data[self.at : self.at + n], self.data[self.at + n : self.at + n + 2]
        if tail != b"\r\n":
            raise ProtocolError("bulk string not followed by CRLF")
        self.at += n + 2
        return body


def parse(data: bytes) -> tuple[list[bytes], int] | None:
    """The first request's arguments and the bytes it took; None if incomplete.

    A blank line or an empty array gives no arguments.
    """
    if not data:
        return None
    r = _Reader(data)
    try:
        head = r.line()
        if not head.startswith(b"*") and not data.startswith(b"*"):
            return head.split(), r.at
        args = []
        for _ in range(r.count(head[1:], MAX_ARGS, "multibulk length")):
            size = r.line()
            if not size.startswith(b"$"):
                raise ProtocolError(f"expected '$', got '{size[:1].decode('latin-1')}'")
            args.append(r.take(r.count(size[1:], MAX_BULK, "bulk length")))
        return args, r.at
    except _More:
        return None


def encode(reply) -> bytes:
    """A reply's bytes; line breaks in simple strings and errors become blanks."""
    tag, content = reply
    if tag in ("simple", "error"):
        return (b"+" if tag == "simple" else b"-") + content.encode().replace(b"\r", b" ").replace(b"\n", b" ") + b"\r\n"
    if tag == "int":
        return b":%d\r\n" % content
    if tag == "bulk":
        return b"$%d\r\n%s\r\n" % (len(content), content)
    if tag == "array":
        return b"*%d\r\n" % len(content) + b"".join(map(encode, content))
    return b"$-1\r\n" if tag == "nil" else b"*-1\r\n"


def request(*args: bytes) -> bytes:
    """A request as an array of bulk strings."""
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


def bulk_column(value):
    """The reply to a get as a column: a bulk string of the value's bytes, or nil."""
    from pyspark.sql import functions as F

    body = value.cast("binary")
    whole = F.concat(F.encode(F.concat(F.lit("$"), F.octet_length(body).cast("string"), F.lit("\r\n")), "UTF-8"), body, F.encode(F.lit("\r\n"), "UTF-8"))
    return F.coalesce(whole, F.encode(F.lit("$-1\r\n"), "UTF-8"))


def commands(requests):
    """Parse a frame ``id, data`` of complete request streams: ``id, pos, name, args``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, data in zip(pdf["id"], pdf["data"], strict=True):
                at, pos = 0, 0
                while (found := parse(bytes(data[at:]))) is not None:
                    args, used = found
                    at += used
                    if args:
                        rows.append((key, pos, args[0].decode("latin-1").upper(), args[1:]))
                        pos += 1
            yield pd.DataFrame(rows, columns=["id", "pos", "name", "args"])

    ship(requests.sparkSession)
    return requests.select("id", "data").mapInPandas(run, "id long, pos long, name string, args array<binary>")
