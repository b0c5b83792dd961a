"""Exact and near duplicates against plain Python."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, simhash
from palimpsest.llm.components import components


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact(spark, documents, edges, nothing):
    for frame in (documents, edges):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        for slots in (64, 1 << 12, None):  # a crowded filter gives the same answer
            assert Counter(tuple(r) for r in exact_dedup.exact_groups(frame, slots=slots).collect()) == exact_brute(rows)
        kept = exact_dedup.drop_exact_copies(frame)
        assert kept.columns == frame.columns
        want = Counter()
        for (i, _, _, keep, digest), n in exact_brute(rows).items():
            if keep:
                want[i, digest] += n
        assert Counter((r["doc_id"], sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.drop_exact_copies(nothing).count() == 0


def test_exact_shuffles_suspects_only(spark, documents):
    plan = exact_dedup.exact_groups(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    slots = exact_dedup.slots_for(documents.count())
    words = exact_dedup.repeated_slots(documents.select(F.coalesce("text", F.lit("")).alias("text")), slots)
    assert words.count() <= 2 * slots / 64
    assert exact_dedup.slots_for(0) == 1 << 16 and exact_dedup.slots_for(10**6) == 1 << 23 and exact_dedup.slots_for(10**12) == exact_dedup.MOST


def print_brute(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(prints):
    parent = {f: f for f in prints.values()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = list(parent)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints.items():
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: (f"{f:016x}", least[root(f)]) for i, f in prints.items()}


def test_near(spark, documents, nothing):
    prints = {r["doc_id"]: print_brute(r["text"]) for r in documents.collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(documents).collect()}
    assert got == groups_brute(prints)
    assert simhash.near_groups(nothing).count() == 0


def test_near_edges(spark, edges):
    got = simhash.near_groups(edges).collect()
    assert len(got) == edges.count()
    prints = {r["doc_id"]: print_brute(r["text"]) for r in edges.filter("doc_id is not null").collect()}
    want = groups_brute(prints)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == want[r["doc_id"]]
    kept = simhash.drop_near_copies(edges)
    assert kept.columns == edges.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, (_, c) in want.items() if i == c}


def test_near_copies_are_judged_row_by_row(spark):
    a, b = "one two three four five six", "something else that nobody has copied at all"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, "words of a row without id"), (9, "twice the same row"), (9, "twice the same row"), (2**62, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("fp", F.lit(0)).withColumn("component_id", F.lit(1))
    want = sorted([(1, a), (5, b), (None, "words of a row without id"), (9, "twice the same row"), (9, "twice the same row")], key=str)
    for most in (1 << 20, 0):  # broadcast, and joined by sorting
        kept = simhash.drop_near_copies(docs, broadcast_rows=most)
        assert kept.columns == docs.columns
        assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == want


def test_a_heavy_group_does_not_shuffle(spark):
    rows = [(k, "copied everywhere" if k % 3 else f"text {k // 6}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    groups = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    assert got == {k: (max(groups[t]), len(groups[t]), k == max(groups[t])) for k, t in rows}


def test_links_find_every_close_pair(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(12)]
    prints = {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for f in base for _ in range(25)} | {0, 1, 7, (1 << 64) - 1, 1 << 63, 0xFFFFFFFF}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    distinct = spark.createDataFrame([(signed(f), signed(f)) for f in prints], "fp long, label long")  # every one a class of its own
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(distinct).collect()}
    assert got == {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    got = {frozenset((r["a"], r["b"])) for r in simhash.neighbours(distinct).collect()}
    assert got == {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() == 1}
    classes = {f: signed(f & ~0xFF) for f in prints}
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(f), c) for f, c in classes.items()], "fp long, label long")).collect()}
    assert got == {tuple(sorted((classes[a], classes[b]))) for a in prints for b in prints if (a ^ b).bit_count() <= 3 and classes[a] != classes[b]}


def test_a_dense_cluster(spark, monkeypatch):
    """All fingerprints within two bits of one: one class, and few pairs."""
    bits = [1 << i for i in range(64)]
    ball = [0] + bits + [a | b for n, a in enumerate(bits) for b in bits[n + 1 :]]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    far = [0xFFFF00FF00FF, 0xFFFF00FF00F0, 0xFFFF00FF0FF8]  # four bits apart, and more
    prints = spark.createDataFrame([(n, 0, signed(f)) for n, f in enumerate(ball + far)], "doc_id long, digest long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: prints)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(prints.withColumn("text", F.lit(""))).collect()}
    assert got == {n: 0 for n in range(len(ball))} | {len(ball) + n: len(ball) + n for n in range(3)}


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(k, 500) for k in range(501, 540)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
