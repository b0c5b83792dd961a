"""Operators on small histories, the driver's queries against their SQL."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.config import MAX_SEQ, Options
from palimpsest.functions import integers
from palimpsest.operators import files, history, reads, stats, transactions, writes
from palimpsest.plans import catalogue

H = "key string, seq long, kind int, value string"


def frame(spark, rows):
    return spark.createDataFrame(rows, H)


def keyseq(df):
    return sorted((r["key"], r["seq"]) for r in df.collect())


def test_shadowed_rule(spark):
    h = frame(spark, [("a", 9, 1, "x"), ("a", 7, 1, "x"), ("a", 5, 1, "x"), ("a", 2, 1, "x"), ("b", 4, 2, None)])
    assert keyseq(history.kept(h, 5)) == [("a", 5), ("a", 7), ("a", 9), ("b", 4)]
    assert keyseq(history.kept(h, 7)) == [("a", 7), ("a", 9), ("b", 4)]
    assert keyseq(history.kept(h, 9)) == [("a", 9), ("b", 4)]
    assert keyseq(history.compacted(h, 9)) == [("a", 9)]
    deep = spark.createDataFrame([("a", "c")], "smallest string, largest string")
    assert keyseq(history.compacted(h, 9, deep)) == [("a", 9), ("b", 4)]  # range, not membership
    assert keyseq(history.compacted(h, 3)) == keyseq(history.kept(h, 3))  # too young to go


def test_compacted_over_many_ranges(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(f"{rnd.randrange(40):02d}", n + 1, rnd.choice([1, 2]), None) for n in range(120)]
    spans = [tuple(sorted((f"{rnd.randrange(45):02d}", f"{rnd.randrange(45):02d}"))) for _ in range(4)]
    deep = spark.createDataFrame(spans, "smallest string, largest string")
    want = keyseq(history.compacted(frame(spark, rows), 80, deep))
    monkeypatch.setattr(history, "MOST_RANGES", 2)
    assert keyseq(history.compacted(frame(spark, rows), 80, deep)) == want
    gone = {k for k, *_ in keyseq(history.kept(frame(spark, rows), 80))} - {k for k, _ in want}
    assert gone and all(not a <= k <= b for k in gone for a, b in spans)


def test_visible_bounds(spark):
    h = frame(spark, [("a", 3, 1, "3"), ("a", 5, 2, None), ("a", 8, 1, "8"), ("", 1, 1, "")])
    look = lambda at: {r["key"]: r["value"] for r in history.visible(h, at).collect()}
    assert look(0) == {} and look(2) == {"": ""} and look(4) == {"": "", "a": "3"} and look(5) == {"": ""} and look(MAX_SEQ) == {"": "", "a": "8"}
    assert history.visible(frame(spark, [])).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["", "a", "ab", "b", "c"]), st.booleans()), max_size=25), st.integers(0, 25), st.sampled_from([None, "", "a", "b"]), st.sampled_from([None, "a", "b", "c"]))
def test_scan_model(spark, ops, at, low, high):
    h = frame(spark, [(k, n + 1, 1 if put else 2, str(n) if put else None) for n, (k, put) in enumerate(ops)])
    model = {}
    for n, (k, put) in enumerate(ops[:at]):
        model[k] = str(n) if put else None
    want = {k: v for k, v in model.items() if v is not None and (low is None or k >= low) and (high is None or k < high)}
    assert {r["key"]: r["value"] for r in reads.scan(h, low, high, at=at).collect()} == want


def test_pages_and_seeks(spark):
    h = frame(spark, [(f"k{n:02d}", n + 1, 1, "v") for n in range(23)])
    seen, cursor = [], 0
    while True:
        rows = reads.page(h, cursor, 5).orderBy("pos").collect()
        seen += [r["key"] for r in rows]
        cursor = rows[0]["next_cursor"] if rows else 0
        if not cursor:
            break
    assert seen == [f"k{n:02d}" for n in range(23)]
    got = {}
    starts = lambda *s: spark.createDataFrame([(x,) for x in s], "start string")
    for r in reads.seek_next(history.visible(h), starts("k05", "k20", "k05", "a", "z", None), 4).collect():
        got.setdefault(r["start"], []).append((r["rn"], r["key"]))
    assert [k for _, k in sorted(got["a"])] == ["k00", "k01", "k02", "k03"]
    assert [k for _, k in sorted(got["k20"])] == ["k20", "k21", "k22"] and "z" not in got
    assert reads.seek_next(history.visible(h), starts(), 4).count() == 0
    assert reads.seek_next(history.visible(h), starts("a"), 0).count() == 0
    assert reads.seek_next(frame(spark, []), starts("a"), 4).count() == 0


def test_seeks_over_partitions(spark):
    rnd = random.Random(4)
    for rows, asked, n in ((300, 200, 7), (5, 100, 20), (200, 3, 150)):
        keys = sorted({f"{rnd.randrange(10**6):06d}" for _ in range(rows)})
        starts = [f"{rnd.randrange(10**6):06d}" for _ in range(asked)] + ["", keys[0], keys[-1], keys[-1] + "x"]
        live = spark.createDataFrame([(bytearray(k.encode()),) for k in keys], "key binary")
        got = sorted((bytes(r["start"]).decode(), r["rn"], bytes(r["key"]).decode()) for r in reads.seek_next(live, spark.createDataFrame([(bytearray(s.encode()),) for s in starts], "start binary"), n).collect())
        assert got == sorted((s, i + 1, k) for s in set(starts) for i, k in enumerate([k for k in keys if k >= s][:n]))


def test_counters_with_failures(spark):
    rows = [("a", 1, "SET", "x"), ("a", 2, "INCR", "1"), ("a", 3, "DEL", None), ("a", 4, "INCR", "5"), ("a", 5, "INCR", " 5 "), ("b", 1, "SET", str(2**63 - 1)), ("b", 2, "INCR", "1"), ("b", 3, "INCR", "-1"), ("c", 1, "DEL", None)]
    got = {r["key"]: (r["value"], r["failed"]) for r in writes.fold_commands(spark.createDataFrame(rows, "key string, seq long, op string, arg string")).collect()}
    assert got == {"a": ("5", 2), "b": (str(2**63 - 2), 1), "c": (None, 0)}


def test_group_verdicts(spark):
    rows = [(0, 1, True, ["a"], ["a"]), (0, 2, True, ["b"], ["a", "b"]), (0, 3, True, ["b"], ["b"]), (0, 4, False, ["b"], ["b"]), (0, 5, True, ["c"], ["b", "c"]), (1, 1, True, ["a"], ["a"])]
    e = spark.createDataFrame(rows, "grp long, ticket long, tx boolean, writes array<string>, checks array<string>")
    got = {(r["grp"], r["ticket"]): r["accepted"] for r in transactions.group_verdicts(e).collect()}
    assert got == {(0, 1): 1, (0, 2): 0, (0, 3): 1, (0, 4): 1, (0, 5): 0, (1, 1): 1}


def test_every_event_is_a_transaction(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").collect()
    want = {a.event_id: int(any(b.user_id == a.user_id and a.event_id - 50 < b.event_id + 1 <= a.event_id for b in rows)) for a in rows}
    got = catalogue.QUERIES["tx_conflicts"](spark, sf_dir).collect()
    assert len(got) == len(want) == 1000 and {r["txid"]: r["conflict"] for r in got} == want and set(want.values()) == {0, 1}


def test_conflicts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(transactions, "BLOCK", 7)
    rnd = random.Random(3)
    versions = [(rnd.choice(["a", "a", "b", None]), seq) for seq in rnd.sample(range(120), 60)]
    asked = [(n // 2, rnd.choice(["a", "b", "c", None]), rnd.randrange(120), rnd.randrange(130)) for n in range(400)]
    asked += [(900, "a", None, 100), (901, "a", 0, None)]
    want = {}
    for tx, key, read, commit in asked:
        hit = None not in (key, read, commit) and any(k == key and read < seq <= commit for k, seq in versions)
        want[tx] = max(want.get(tx, 0), int(hit))
    got = transactions.conflicts(spark.createDataFrame(versions, "key string, seq long"), spark.createDataFrame(asked, "tx_id long, key string, read_seq long, commit_seq long")).collect()
    assert len(got) == len(want) and {r["tx_id"]: r["conflict"] for r in got} == want


def test_every_group_is_judged(spark, sf_dir):
    written, want = {}, {}
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        grp, key, lock = e["event_id"] // 20, e["user_id"] % 12, (e["user_id"] + e["event_id"]) % 12
        seen = written.setdefault(grp, set())
        ok = e["event_id"] % 4 == 0 or not seen & {key, lock}
        seen |= {key} if ok else set()
        want[grp, e["event_id"]] = int(ok)
    got = catalogue.QUERIES["tx_group_conflicts"](spark, sf_dir).collect()
    assert len(got) == len(want) == 1000 and {(r["grp"], r["ticket"]): r["accepted"] for r in got} == want


def test_greedy_folds(spark):
    e = spark.createDataFrame([(q, t, b) for q in (1, 2) for t, b in enumerate([50, 60, 40, 200, 1, 99])], "queue long, ticket long, bytes long")
    got = [r["grp"] for r in writes.write_groups(e, 100).filter("queue = 1").orderBy("ticket").collect()]
    assert got == [0, 1, 1, 2, 3, 3]
    s = spark.createDataFrame([(0, k, 9 - n, 60) for n, k in enumerate("aaabbc")], "part long, key string, seq long, bytes long")
    parts = writes.split_files(s, 100).groupBy("file").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("file").collect()
    assert [(r["a"], r["b"]) for r in parts] == [("a", "a"), ("b", "b"), ("c", "c")]


def greedy_brute(sizes, limit, ends_full):
    out, group, total = [], -1, None
    for n in sizes:
        if total is None or (total >= limit if ends_full else total + n > limit):
            group, total = group + 1, 0
        total += n
        out.append(group)
    return out


@pytest.mark.parametrize("ends_full", [False, True])
def test_greedy_cuts_over_blocks(spark, ends_full):
    rnd = random.Random(6)
    queues = {q: [rnd.choice([0, 1, rnd.randrange(60), rnd.randrange(250)]) for _ in range(rnd.randrange(1, 160))] for q in range(6)} | {6: [0] * 50, 7: [1000] * 40}
    e = spark.createDataFrame([(q, 3 * t, n) for q, sizes in queues.items() for t, n in enumerate(sizes)], "queue long, at long, bytes long")
    for block in (7, 64, 1 << 14):
        got = {}
        for r in writes.greedy_cuts(e, "at", "grp", 100, ends_full, block).orderBy("at").collect():
            got.setdefault(r["queue"], []).append(r["grp"])
        assert got == {q: greedy_brute(sizes, 100, ends_full) for q, sizes in queues.items()}


def test_split_files_by_batches(spark):
    rnd = random.Random(7)
    rows = [(p, f"{k:04d}", s, rnd.randrange(80)) for p in range(3) for k in range(120) for s in range(rnd.randrange(1, 5))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["part"], r["key"], r["seq"]): r["file"] for r in writes.split_files(spark.createDataFrame(rows, "part long, key string, seq long, bytes long"), 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state = {}, {}
    for p, k, s, n in sorted(rows, key=lambda r: (r[0], r[1], -r[2])):
        file, total, last = state.get(p, (0, 0, None))
        if total >= 300 and k != last:
            file, total = file + 1, 0
        want[p, k, s] = file
        state[p] = file, total + n, k
    assert got == want


def test_command_runs(spark):
    rnd = random.Random(8)
    args = ["1", "-3", "+7", " 5 ", "x", str(2**63 - 1), str(-(2**63)), str(2**62), "00012", ""]
    rows = [(f"k{k}", n, rnd.choice(["SET", "DEL", "INCR", "INCR", "INCR", "INCR"]), rnd.choice(args)) for k in range(60) for n in range(rnd.randrange(1, 25))]
    want = {}
    for key, _, op, arg in rows:
        value, failed = want.get(key, (None, 0))
        if op != "INCR":
            value = arg if op == "SET" else None
        else:
            now, by = 0 if value is None else integers.parse(value.encode()), integers.parse(arg.encode())
            if now is None or by is None or not -(2**63) <= now + by < 2**63:
                failed += 1
            else:
                value = str(now + by)
        want[key] = value, failed
    got = writes.fold_commands(spark.createDataFrame(rows, "key string, seq long, op string, arg string")).collect()
    assert len(got) == len(want) and {r["key"]: (r["value"], r["failed"]) for r in got} == want


def test_many_snapshot_bounds(spark, monkeypatch):
    monkeypatch.setattr(history, "MOST_BOUNDS", 4)
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), n + 1, rnd.choice([1, 1, 2]), str(n)) for n in range(60)]
    bounds = sorted(rnd.sample(range(-3, 75), 11))
    got = sorted((r["bound"], r["key"], r["value"]) for r in history.visible_at_each(frame(spark, rows), spark.createDataFrame([(b,) for b in bounds], "bound long")).collect())
    want = []
    for b in bounds:
        last = {k: (kind, v) for k, s, kind, v in rows if s <= b}
        want += [(b, k, v) for k, (kind, v) in last.items() if kind == 1]
    assert got == sorted(want)
    assert history.visible_at_each(frame(spark, rows), spark.createDataFrame([], "bound long")).count() == 0


def test_holding_by_cells(spark, monkeypatch):
    monkeypatch.setattr(files, "CELLS", 5)
    rnd = random.Random(10)
    spans = [(i, *sorted((f"{rnd.randrange(1000):04d}", f"{rnd.randrange(1000):04d}"))) for i in range(40)] + [(99, None, None)]
    keys = [f"{rnd.randrange(1100):04d}" for _ in range(200)] + ["", None]
    got = sorted((r["id"], r["key"]) for r in files.holding(spark.createDataFrame(spans, "id long, smallest string, largest string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect())
    assert got == sorted((i, k) for i, a, b in spans if a is not None for k in {x for x in keys if x is not None} if a <= k <= b)


def test_file_rules(spark):
    f = spark.createDataFrame([(1, 1, "a", "c", 5, 10), (2, 1, "c", "d", 5, 10), (3, 1, "e", "f", 5, 10), (4, 2, "x", "y", 5, 10)], "id long, level int, smallest string, largest string, entry_count long, file_size long")
    assert [r["id"] for r in files.level_overlaps(f).collect()] == [2]  # a shared edge overlaps
    assert files.trivial_move(f.filter("id = 1"), f.filter("level = 2")).first()["movable"] == 1
    assert files.trivial_move(f.filter("id in (1, 2)"), f.filter("level = 2")).first()["movable"] == 0
    assert files.trivial_move(f.filter("id = 3"), f.filter("id = 3")).first()["movable"] == 0
    assert files.pick_level(f, Options(level1_max_bytes=15, level_multiplier=1)).first()["level"] == 1
    edits = [(1, "FORMAT", 5, None), (2, "ADD", 1, 0), (3, "ADD", 1, 0), (4, "REMOVE", 9, None), (5, "LASTSEQ", 5, None), (6, "LASTSEQ", 4, None), (7, "FORMAT", 5, None), (8, "ADD", 2, 7), (9, "REMOVE", 1, None), (10, "REMOVE", 1, None)]
    bad = {r["pos"] for r in files.edit_violations(spark.createDataFrame(edits, "pos long, op string, id long, level int")).collect()}
    assert bad == {3, 4, 6, 7, 8, 10}


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert tuple(stats.percentiles(v, "v", {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}).first()) == (0.0, 5.0, 9.0, 9.0)
    assert stats.write_amplification(spark.createDataFrame([], "kind string, n_bytes long")).first()["write_amp"] == 0.0


def test_first_seqs_over_blocks(spark):
    e = spark.range(9000).selectExpr("id as ticket", "id % 4 as ops", "id % 5 > 0 as accepted")
    at, want = 10, {}
    for t in range(9000):
        n = t % 4 if t % 5 else 0
        want[t] = (at + 1 if n else None, at + n)
        at += n
    assert {r["ticket"]: (r["first_seq"], r["last_seq"]) for r in writes.first_seqs(e, 10).collect()} == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    got = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert mine
        return
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    r = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(dict(zip(names, row))[c]) for c in cols) for row in r.fetchall()), key=repr)
    assert mine == theirs
