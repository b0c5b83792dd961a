"""Store options and fixed limits."""

from __future__ import annotations

from dataclasses import dataclass

from palimpsest.errors import InvalidArgument

# Fixed values of the data model and of the file layouts.
LEVELS = 7
GROUP_BYTES = 1 << 20
BLOCK_BYTES = 4096
RESTART_EVERY = 16
ENTRY_HEADER = 17
MAX_SEQ = (1 << 63) - 1
FORMATS = (2, 3, 4, 5)
PUT, DELETE, BATCH = 1, 2, 3


@dataclass(frozen=True)
class Options:
    """Knobs of a store; none of them changes what a read returns.

    ``memtable_bytes``: committed versions held on the driver before they become a
    file.  ``bloom_bits_per_key``: key filters of files, 0 for none.
    ``block_cache_bytes``: results of point lookups held, 0 for none.  ``sync``:
    "always" makes every group of writes durable before it is acknowledged,
    "periodic" within ``sync_ms``.  ``checkpoint_every``: commits between two
    checkpoints of the log; ``vacuum`` keeps ``retain_versions`` commits before one.
    """

    memtable_bytes: int = 4 << 20
    l0_compaction_trigger: int = 4
    l0_slowdown: int = 8
    l0_stop: int = 12
    level1_max_bytes: int = 10 << 20
    level_multiplier: int = 10
    target_file_bytes: int = 2 << 20
    bloom_bits_per_key: int = 10
    block_cache_bytes: int = 8 << 20
    sync: str = "always"
    sync_ms: int = 100
    checkpoint_every: int = 128
    retain_versions: int = 10

    def __post_init__(self):
        if not self.l0_compaction_trigger <= self.l0_slowdown <= self.l0_stop:
            raise InvalidArgument("need l0_compaction_trigger <= l0_slowdown <= l0_stop")
        if self.sync not in ("always", "periodic"):
            raise InvalidArgument("sync is 'always' or 'periodic'")

    def level_limit(self, level: int) -> int:
        """Bytes level ``level`` (from 1) may hold before it is due."""
        return min(self.level1_max_bytes * self.level_multiplier ** (level - 1), MAX_SEQ)
