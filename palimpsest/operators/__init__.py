"""Operators: DataFrame in, DataFrame out.

A history has the columns ``key, seq, kind, value`` with kind 1 for a put and 2
for a deletion, as in :mod:`palimpsest.schema`; keys may be strings or bytes.
"""
