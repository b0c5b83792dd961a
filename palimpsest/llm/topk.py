"""Exact top-k inner products by ball-tree branch and bound, shard by shard.

The space is cut by planes into cells, drawn from a bounded sample; every vector is
dealt to its cell, and each cell's vectors, in shards of bounded size, get one ball
tree that is built once and stored.  A query meets the cells in the order of their
inner-product upper bounds.  It searches the best one first; the k-th score found
there is its floor, which rules cells out before anything moves, then the next few
under the risen floor, then the rest.  Within a tree, nodes are visited best first and
a query drops out of a node whose bound is below its floor, and of a leaf the points
whose own bound is.
"""

from __future__ import annotations

import heapq
import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, written

LEAF = 64
#: Cells at most, and sample rows for each; both bound what the driver holds.
CELLS, PER_CELL = 1024, 8
#: Cells by their place in a query's order that each round searches.
ROUNDS = ((0, 1), (1, 4), (4, CELLS))


class BallTree:
    """Balls over the rows of ``x``, which are put in order so that a node is a range.

    Rows of a leaf stand by falling distance from its center.
    """

    def __init__(self, x, leaf: int = LEAF):
        import numpy as np

        order, nodes, stack = np.arange(len(x)), [], [(0, len(x), -1, 0)] if len(x) else []
        far = np.zeros(len(x))
        while stack:
            a, b, parent, side = stack.pop()
            own = x[order[a:b]]
            center = own.mean(axis=0)
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append([center, float(away.max()), a, b, -1, -1])
            if parent >= 0:
                nodes[parent][4 + side] = me
            if b - a <= leaf or away.max() == 0:
                by = np.argsort(-away, kind="stable")
                order[a:b], far[a:b] = order[a:b][by], away[by]
                continue
            p = own[away.argmax()]
            q = own[((own - p) ** 2).sum(axis=1).argmax()]
            by, half = np.argsort(own @ (q - p), kind="stable"), (b - a) // 2
            order[a:b] = order[a:b][by]
            stack += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.x, self.order, self.far, self.nodes = x[order], order, far, nodes


class Best:
    """The k best (score, id) of every query, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor):
        import numpy as np

        self.k, self.floor, self.scored = k, floor.copy(), 0
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q, s, i):
        import numpy as np

        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def _bound(queries, norms, center, radius):
    """Upper bounds of inner products with a ball, a little above rounding errors."""
    import numpy as np

    top = queries @ center + norms * radius
    return top + 1e-9 * np.abs(top) + 1e-6


def search(queries, query_ids, tree: BallTree, ids, k: int, floor) -> Best:
    """Best ``k`` rows of a tree for every query, but its own id.

    ``ids`` are those of the tree's rows in its order.
    """
    import numpy as np

    best = Best(len(queries), k, floor)
    if not tree.nodes or not len(queries):
        return best
    norms = np.sqrt((queries**2).sum(axis=1))
    everyone = np.arange(len(queries))
    first = _bound(queries, norms, *tree.nodes[0][:2])
    heap = [(-first.max(), 0, everyone, first)]
    while heap:
        _, n, active, top = heapq.heappop(heap)
        active = active[top >= best.floor[active]]
        if not len(active):
            continue
        center, _, a, b, *children = tree.nodes[n]
        if children[0] >= 0:
            for child in children:
                up = _bound(queries[active], norms[active], *tree.nodes[child][:2])
                stay = up >= best.floor[active]
                if stay.any():
                    heapq.heappush(heap, (-up[stay].max(), child, active[stay], up[stay]))
            continue
        # points nearer to the center than any query needs are below every floor
        least = ((best.floor[active] - queries[active] @ center - 1e-6) / np.maximum(norms[active], 1e-300)).min()
        b = a + int(np.searchsorted(-tree.far[a:b], -(least - 1e-9 * abs(least)), "right")) if np.isfinite(least) else b
        for at in range(a, b, 1024):  # equal vectors can make a large leaf
            rows = slice(at, min(at + 1024, b))
            scores = queries[active] @ tree.x[rows].T
            best.scored += scores.size
            hit = (scores >= best.floor[active][:, None]) & (query_ids[active][:, None] != ids[rows][None, :])
            i, j = np.nonzero(hit)
            if len(i):
                best.add(active[i], scores[i, j], ids[rows][j])
    return best


class Cells:
    """Planes that cut the space into about ``parts`` cells with equal shares of a sample."""

    def __init__(self, sample, parts: int):
        import numpy as np

        self.nodes, self.count = [], 0  # (direction, threshold, left, right); a negative child is a cell
        parts = max(1, min(parts, len(sample) // PER_CELL))
        stack = [(np.arange(len(sample)), parts, -1, 0)]
        while stack:
            rows, share, parent, side = stack.pop()
            own = sample[rows]
            spread = len(own) and bool((own != own[0]).any())
            if share <= 1 or not spread:
                me, self.count = -1 - self.count, self.count + 1
            else:
                p = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                along = own @ (q - p)
                order, half = np.argsort(along, kind="stable"), len(own) * (share // 2) // share
                me = len(self.nodes)
                self.nodes.append([q - p, float(along[order[half]]), 0, 0])
                below = along < self.nodes[me][1]
                stack += [(rows[below], share // 2, me, 2), (rows[~below], share - share // 2, me, 3)]
            if parent >= 0:
                self.nodes[parent][side] = me

    def of(self, x):
        """The cell of every row."""
        import numpy as np

        out, stack = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            n, rows = stack.pop()
            direction, threshold, left, right = self.nodes[n]
            below = x[rows] @ direction < threshold
            for child, some in ((left, rows[below]), (right, rows[~below])):
                if child < 0:
                    out[some] = -1 - child
                elif len(some):
                    stack.append((child, some))
        return out


def _matrix(column, width: int):
    """An Arrow column of packed doubles as a matrix."""
    import numpy as np

    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, "<f8").reshape(-1, width) if packed else np.zeros((0, width))


def _padded(column, width: int):
    """An Arrow column of lists of numbers as a matrix, padded with zeros."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


def top_k(
    vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, shard_rows: int = 8192, block_rows: int = 8192,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is
    divisible by ``query_every``; a row is no candidate of a query with its own id.
    Rows that repeat a query's id and vector are one query, and count each as
    candidates of others; an id with several vectors is several queries.  Vectors that
    are null, or hold null or non-finite components, and rows without id take no part;
    shorter vectors count as padded with zeros.  Scores are exact below 2**53.  Returns
    ``query_id, rank, vec_id, score``; a query without candidates has no rows, an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector")
    )
    n, width = rows.agg(F.count("id"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    width = max(1, width)
    shard_rows = max(1, min(shard_rows, (16 << 20) // (8 * width)))
    parts = min(CELLS, -(-n // shard_rows))
    wanted = min(parts * PER_CELL * 4, max(PER_CELL, (16 << 20) // (8 * width)))
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30)))
    sample = rows.filter(drawn).orderBy("id").limit(2 * wanted).toArrow() if parts > 1 else None  # bounded by rows and bytes
    import numpy as np

    cells = Cells(np.zeros((0, width)) if sample is None else _padded(sample.column("vector").combine_chunks(), width), parts)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            x = _padded(batch.column(1), width)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(cells.of(x), pa.int32())], names=["id", "vector", "cell"])

    dealt = written(rows.mapInArrow(deal, "id long, vector binary, cell int"), "vectors")
    # large cells hold several shards; one row a cell
    shares = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    shares = spark.createDataFrame([(r["cell"], r["shards"]) for r in shares.collect()], "cell int, shards int")

    def plant(key, t):
        import pyarrow as pa

        x, ids = _matrix(t.column("vector"), width), t.column("id").to_numpy()
        tree = BallTree(x)
        tree_ids = ids[tree.order]
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32()),
            "center": pa.array([tree.nodes[0][0].tobytes()], pa.binary()), "radius": pa.array([tree.nodes[0][1]]), "tree": pa.array([pickle.dumps((tree, tree_ids))], pa.binary()),
        })

    sub = F.pmod(F.xxhash64("id", F.lit("sub")), F.col("shards")).cast("int")
    trees = written(
        dealt.join(F.broadcast(shares), "cell").select("id", "vector", "cell", sub.alias("sub")).groupBy("cell", "sub").applyInArrow(plant, "cell int, sub int, center binary, radius double, tree binary"),
        "ball-trees",
    )

    def around(key, t):
        import pyarrow as pa

        centers, radii = _matrix(t.column("center"), width), t.column("radius").to_numpy()
        center = centers.mean(axis=0)
        radius = (np.sqrt(((centers - center) ** 2).sum(axis=1)) + radii).max() * (1 + 1e-12)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "center": pa.array([center.tobytes()], pa.binary()), "radius": pa.array([radius])})

    balls = trees.select("cell", "center", "radius").groupBy("cell").applyInArrow(around, "cell int, center binary, radius double").orderBy("cell").toArrow()  # at most CELLS rows
    centers, radii, numbers = _matrix(balls.column("center"), width), balls.column("radius").to_numpy(), balls.column("cell").to_numpy()

    def visits(span):
        """The cells a query meets at some places of its order, unless its floor rules them out."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    q = _matrix(part.column(1), width)
                    top = q @ centers.T + np.sqrt((q**2).sum(axis=1))[:, None] * radii[None, :]
                    top += 1e-9 * np.abs(top) + 1e-6
                    order = np.argsort(-top, axis=1, kind="stable")[:, span[0] : span[1]]
                    i, j = np.nonzero(np.take_along_axis(top, order, axis=1) >= part.column(2).to_numpy()[:, None])
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(i)) for c in part.columns] + [pa.array(numbers[order[i, j]].astype(np.int32))], names=["query_id", "vector", "floor", "cell"])

        return run

    def answer(batches):
        """Trees and queries by shard, each tree before its queries: one tree is held."""
        import pyarrow as pa

        tree = ids = None
        for batch in batches:
            kinds, blobs = batch.column(3).to_pylist(), batch.column(5)
            edges = [p for p, kind in enumerate(kinds) if kind == 0] + [len(kinds)]
            spans = [(0, edges[0])] + [(a, b) for a, b in zip(edges, edges[1:], strict=False)]
            for a, b in spans:
                if a < b and kinds[a] == 0:
                    tree, ids = pickle.loads(blobs[a].as_py())
                    a += 1
                for at in range(a, b, 1024):
                    part = batch.slice(at, min(1024, b - at))
                    q, q_ids = _matrix(part.column(5), width), part.column(4).to_numpy()
                    best = search(q, q_ids, tree, ids, k, part.column(6).to_numpy().astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.q]), part.column(5).take(pa.array(best.q)), pa.array(best.i), pa.array(best.s.astype(np.int64))], names=["query_id", "vector", "vec_id", "score"])

    planted = trees.select("cell", "sub")  # two numbers per shard of thousands of vectors
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, planted.count()))
    asking = dealt.filter(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), "vector").distinct()
    found = None
    for first, last in ROUNDS:
        if first >= max(1, len(numbers)):
            break
        if found is None:
            floors = asking.withColumn("floor", F.lit(float("-inf")))
        else:
            rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("score")))
            low = found.withColumn("_rank", rank).filter(F.col("_rank") == k).select("query_id", "vector", F.col("score").cast("double").alias("floor"))
            floors = asking.join(low, ["query_id", "vector"], "left").select("query_id", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        met = floors.mapInArrow(visits((first, last)), "query_id long, vector binary, floor double, cell int")
        met = written(met.join(planted, "cell"), "visits")
        # a shard that many queries visit is searched in several places, up to one per task
        share = F.least(F.lit(block_rows), F.greatest(F.lit(LEAF), F.ceil(F.count(F.lit(1)) / tasks)))
        blocks = met.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("blocks"))
        placed = met.join(blocks, ["cell", "sub"]).withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.col("blocks")).cast("int"))
        stored = trees.join(blocks, ["cell", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = lambda kind, ident, blob, floor: ["cell", "sub", "block", F.lit(kind).cast("byte").alias("kind"), ident.alias("ident"), F.col(blob).alias("blob"), floor.alias("floor")]
        both = stored.select(*columns(0, F.lit(0).cast("long"), "tree", F.lit(0.0))).unionByName(placed.select(*columns(1, F.col("query_id"), "vector", F.col("floor"))))
        stream = both.repartition("cell", "sub", "block").sortWithinPartitions("cell", "sub", "block", "kind")
        hits = written(stream.mapInArrow(answer, "query_id long, vector binary, vec_id long, score long"), "hits")
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
