"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, written


def _with_least(links: DataFrame) -> DataFrame:
    """Directed links ``(u, v)`` with ``m``, the least of ``u`` and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected links ``(a, b)``.

    The component is its smallest node.  A large-star step links the larger
    neighbours of each node to its least neighbour, a small-star step the smaller
    ones, until all links are stars, which takes a number of rounds of the order of
    the squared logarithm of the nodes.  Every round is written to the shared folder
    and the round before removed; no round collects links or nodes.  Null nodes and
    links of a node with itself are ignored, repeated links count once.
    """
    now = written(
        links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: from a node to its smaller neighbours only
        met = _with_least(large)
        small = (
            met.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(met.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        after = written(small, "links")
        discard(now)
        # a star forest: every node has one smaller neighbour, itself with none
        open_ends = after.groupBy("u").agg(F.count("v").alias("n"), F.min("v").alias("v")).filter("n > 1").select("u")
        deeper = after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi")
        done = open_ends.unionByName(deeper).isEmpty()
        now = after
        if done:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
