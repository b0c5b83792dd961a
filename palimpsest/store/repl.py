"""A line-by-line shell over a store.

    python -m palimpsest.store.repl DIR

Commands: put K V, get K, del K, scan [FROM [TO]], snap, sget K, sscan, unsnap, flush,
compact, stats, quit.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from palimpsest.errors import StoreError
from palimpsest.store.store import Snapshot, Store

# Fixed values of the shell: how many pairs a scan shows before it only counts, and its replies.
SHOWN = 50
DONE, NOTHING, NO_SNAPSHOT, UNKNOWN = "OK", "(nil)", "no snapshot (use snap)", "unknown command"


def _text(data: bytes | None) -> str:
    return NOTHING if data is None else data.decode("utf-8", "replace")


class Shell:
    """One session: a store, and the snapshot taken last."""

    def __init__(self, store: Store, say: Callable[[str], None] = print):
        self.store, self.say = store, say
        self.snap: Snapshot | None = None

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            words = line.split()
            if words and words[0] in ("quit", "exit"):
                break
            if words:
                self.line(words)
        self.do_unsnap(quiet=True)

    def line(self, words: list[str]) -> None:
        verb = getattr(self, f"do_{words[0]}", None)
        fits = {"put": (2,), "get": (1,), "del": (1,), "scan": (0, 1, 2), "sget": (1,)}.get(words[0], (0,))
        if verb is None or len(words) - 1 not in fits:
            self.say(UNKNOWN)
            return
        try:
            verb(*words[1:])
        except StoreError as e:
            self.say(f"error: {e}")

    def do_put(self, key: str, value: str) -> None:
        self.store.put(key.encode(), value.encode())
        self.say(DONE)

    def do_get(self, key: str) -> None:
        self.say(_text(self.store.get(key.encode())))

    def do_del(self, key: str) -> None:
        self.store.delete(key.encode())
        self.say(DONE)

    def do_scan(self, low: str | None = None, high: str | None = None) -> None:
        self._show(self.store.scan(low and low.encode(), high and high.encode()))

    def do_snap(self) -> None:
        self.do_unsnap(quiet=True)
        self.snap = self.store.snapshot()
        self.say(f"snapshot at seq {self.snap.sequence}")

    def do_sget(self, key: str) -> None:
        self.say(_text(self.snap.get(key.encode())) if self.snap else NO_SNAPSHOT)

    def do_sscan(self) -> None:
        if self.snap:
            self._show(self.snap.iter())
        else:
            self.say(NO_SNAPSHOT)

    def do_unsnap(self, quiet: bool = False) -> None:
        if self.snap is not None:
            self.snap.release()
            self.snap = None
        if not quiet:
            self.say(DONE)

    def do_flush(self) -> None:
        self.store.flush()
        self.say(DONE)

    def do_compact(self) -> None:
        self.store.compact_all()
        self.say(DONE)

    def do_stats(self) -> None:
        for name, value in self.store.stats().items():
            self.say(f"{name}: {value:.2f}" if isinstance(value, float) else f"{name}: {value}")

    def _show(self, pairs) -> None:
        first = pairs.orderBy("key").limit(SHOWN + 1).collect()
        for r in first[:SHOWN]:
            self.say(f"{_text(bytes(r['key']))} = {_text(bytes(r['value']))}")
        self.say(f"({len(first) if len(first) <= SHOWN else pairs.count()} keys)")


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    path = (argv if argv is not None else sys.argv[1:])[0]
    spark = SparkSession.builder.appName("palimpsest-shell").getOrCreate()
    with Store(spark, path) as store:
        Shell(store).run(sys.stdin)


if __name__ == "__main__":
    main()
