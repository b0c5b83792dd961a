"""Ball-tree search against a plain sort of all scores."""

import math
import random

import numpy as np
import pytest

from palimpsest.llm.topk import BallTree, Cells, search, top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shards,blocks", [(1000, 1000), (60, 1000), (37, 5), (1, 1000)])
def test_against_brute_force(spark, shards, blocks):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, [1.0] * 8) for i in range(150, 230)]  # many ties
    rows += [(300, None), (320, [float("nan")] * 8), (340, [None] * 8), (360, [float("inf")] * 8), (380, []), (400, [2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, id int, block int")
    if shards == 1:
        frame = frame.filter("vec_id < 25 or vec_id in (160, 161)")
        rows = [(i, v) for i, v in rows if i is not None and (i < 25 or i in (160, 161))]
    got = {tuple(r) for r in top_k(frame, k=7, shard_rows=shards, block_rows=blocks).collect()}
    assert got == brute(rows, 7, 20)


def test_repeated_ids(spark):
    """Equal rows are one query and several candidates; an id with two vectors is two queries."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [3.0, -1.0]), (20, [0.0, 5.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (7, [2.0, 0.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect())
    want = []
    for q, a in sorted({(i, tuple(v)) for i, v in rows if i % 20 == 0}):
        scored = sorted((-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b)), i) for i, b in rows if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    assert got == sorted(want)


def test_cells_share_the_sample():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 6))
    cells = Cells(x, 50)
    sizes = np.bincount(cells.of(x))
    assert cells.count == len(sizes) and 40 <= len(sizes) <= 60 and sizes.max() < 4 * sizes.mean()
    assert Cells(np.ones((100, 3)), 8).count == 1 and Cells(np.zeros((0, 3)), 8).count == 1


def test_search_prunes_what_can_be_pruned():
    rnd = np.random.default_rng(2)
    x = np.concatenate([c + rnd.normal(0, 0.5, (200, 8)) for c in rnd.normal(0, 40, (30, 8))])
    tree, q = BallTree(x), x[::100]
    best = search(q, np.full(len(q), -1), tree, tree.order, 5, np.full(len(q), -np.inf))
    assert best.scored < 0.25 * len(x) * len(q)
    want = np.sort(q @ x.T, axis=1)[:, -5:]
    for n in range(len(q)):
        assert np.allclose(np.sort(best.s[best.q == n]), want[n])


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
