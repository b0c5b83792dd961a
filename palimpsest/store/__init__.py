"""A persistent store: data files, a commit log, maintenance, sessions."""

from palimpsest.store.store import Store

__all__ = ["Store"]
