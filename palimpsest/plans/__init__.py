"""Registered queries and their SQL."""

from palimpsest.plans import catalogue, lifecycle

__all__ = ["catalogue", "lifecycle"]
