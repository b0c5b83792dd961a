"""Durability, crashes, group commit, raw directories, counts, and the shell."""

import random
import threading

import pytest

from palimpsest.config import Options
from palimpsest.errors import Conflict, Corruption, InvalidArgument, Poisoned
from palimpsest.sources import manifest, wal
from palimpsest.store import Store
from palimpsest.store.log import Files
from palimpsest.store.memtable import Memtable
from palimpsest.store.raw import contents, dump, recover
from palimpsest.store.repl import Shell
from palimpsest.store.store import WriteBatch


def pairs(frame):
    return {bytes(r["key"]): bytes(r["value"]) for r in frame.collect()}


class Faulty(Files):
    """Loses what was not made durable when it crashes, and fails when told to."""

    def __init__(self, spark, root):
        super().__init__(spark, root)
        self.loose, self.broken = [], False

    def create_once(self, name, data, durable=True):
        if self.broken:
            raise OSError("disk full")
        made = super().create_once(name, data, durable)
        if made and not durable:
            self.loose.append(name)
        return made

    def sync(self, name):
        if self.broken:
            raise OSError("disk full")
        super().sync(name)
        if name in self.loose:
            self.loose.remove(name)

    def crash(self, rnd):
        """Any of the loose files may be whole, cut short, empty or gone."""
        for name in self.loose:
            data = self.read(name)
            what = rnd.randrange(4)
            if what == 0:
                self.delete(name)
            elif what < 3:
                self.write(name, data[: rnd.randrange(len(data))] if what == 1 else b"")
        self.loose = []


def random_batch(rnd):
    b = WriteBatch()
    for _ in range(rnd.randrange(1, 4)):
        key = b"k%03d" % rnd.randrange(30)
        b.put(key, b"v%d" % rnd.randrange(10**6)) if rnd.random() < 0.75 else b.delete(key)
    return b


def after(model, batch):
    model = dict(model)
    for _, key, value in batch.ops:
        if value is None:
            model.pop(key, None)
        else:
            model[key] = value
    return model


def test_recovered_is_durable_and_a_prefix(spark, tmp_path):
    """After a crash a store holds all that was made durable, then some prefix of the rest."""
    for seed in range(6):
        rnd, path = random.Random(seed), str(tmp_path / f"s{seed}")
        states, floor = [{}], 0
        for epoch in range(3):
            options = Options(sync="periodic", sync_ms=10**9, checkpoint_every=rnd.choice([3, 1000]), memtable_bytes=10**6)
            files = Faulty(spark, path)
            store = Store(spark, path, options, files)
            got = pairs(store.iter())
            assert got in states[floor:], (seed, epoch)
            states, floor = [got], 0
            for _ in range(rnd.randrange(5, 30)):
                batch = random_batch(rnd)
                store.write(batch)
                states.append(after(states[-1], batch))
                if rnd.random() < 0.15:
                    store.sync()
                    floor = len(states) - 1
            store.timer.cancel()
            files.crash(rnd)
        store = Store(spark, path)
        assert pairs(store.iter()) in states[floor:]
        assert all(store.get(k) == v for k, v in pairs(store.iter()).items())  # a scan agrees with gets


def test_always_loses_nothing(spark, tmp_path):
    files = Faulty(spark, str(tmp_path / "s"))
    store, model, rnd = Store(spark, str(tmp_path / "s"), None, files), {}, random.Random(1)
    for _ in range(25):
        batch = random_batch(rnd)
        store.write(batch)
        model = after(model, batch)
    files.crash(rnd)
    assert not files.loose and store.stats()["wal_syncs"] >= 25
    assert pairs(Store(spark, str(tmp_path / "s")).iter()) == model


def test_damage_below_what_is_durable_is_corruption(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, Options(sync="periodic", sync_ms=10**9))
    store.put(b"a", b"1")
    store.sync()
    store.put(b"b", b"2")  # says that all before it is durable
    name = "log/%020d.json" % 2
    store.files.write(name, store.files.read(name)[:-1])
    with pytest.raises(Corruption):
        Store(spark, path)


def test_poison_refuses_writes_and_reads_on(spark, tmp_path):
    files = Faulty(spark, str(tmp_path / "s"))
    store = Store(spark, str(tmp_path / "s"), None, files)
    store.put(b"a", b"1")
    files.broken = True
    for attempt in (lambda: store.put(b"b", b"2"), store.flush, lambda: store.delete(b"a")):
        with pytest.raises(Poisoned, match="disk full"):
            attempt()
    files.broken = False
    with pytest.raises(Poisoned):
        store.put(b"b", b"2")
    assert store.get(b"a") == b"1" and pairs(store.iter()) == {b"a": b"1"}
    assert pairs(Store(spark, str(tmp_path / "s")).iter()) == {b"a": b"1"}


def test_periodic_syncs_by_itself_and_at_close(spark, tmp_path):
    import time

    store = Store(spark, str(tmp_path / "s"), Options(sync="periodic", sync_ms=20))
    store.put(b"a", b"1")
    assert store.state.synced < store.state.version
    for _ in range(100):
        if store.state.synced == store.state.version:
            break
        time.sleep(0.02)
    assert store.state.synced == store.state.version and store.stats()["wal_syncs"] == 1
    store.put(b"b", b"2")
    store.close()
    assert store.state.synced == store.state.version
    with pytest.raises(Poisoned, match="closed"):
        store.put(b"c", b"3")


def test_writers_share_a_group(spark, tmp_path):
    """Writers that queue while one commits go together, in order, each failing alone."""
    store = Store(spark, str(tmp_path / "s"))
    store.put(b"x", b"0")
    loser, winner = store.transaction(), store.transaction()
    loser.put(b"x", b"1")
    loser.get_for_update(b"y")
    winner.put(b"y", b"2")
    failed, threads = [], []

    def run(what):
        try:
            what()
        except Conflict as e:
            failed.append(e)

    before = store.stats()
    with store.lock:  # nobody can lead yet
        for n, what in enumerate([lambda: winner.commit(), lambda: loser.commit(), *(lambda k=k: store.put(b"p%d" % k, b"v") for k in range(8))], 1):
            t = threading.Thread(target=run, args=(what,))
            t.start()
            threads.append(t)
            while len(store.queue) < n:  # in this order
                pass
    [t.join() for t in threads]
    s = store.stats()
    assert len(failed) == 1 and s["write_groups"] == before["write_groups"] + 1 and s["writes"] == before["writes"] + 9
    assert store.multi_get([b"x", b"y", b"p7"]) == [b"0", b"2", b"v"] and s["last_sequence"] == 10
    assert sum(n.endswith(".json") for n in store.files.list("log")) == 3  # the format, one put, one group


def test_group_limit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    big = b"x" * (400 << 10)
    threads = [threading.Thread(target=store.put, args=(b"k%d" % k, big)) for k in range(5)]
    with store.lock:
        for n, t in enumerate(threads, 1):
            t.start()
            while len(store.queue) < n:
                pass
    [t.join() for t in threads]
    assert store.stats()["write_groups"] == 3  # two of 400 KiB fit into 1 MiB


def test_memtable():
    m = Memtable()
    for seq, kind, value in ((1, 1, b"a"), (4, 2, None), (9, 1, b"b")):
        m.add(b"k", seq, kind, value)
    m.add(b"j", 5, 1, b"")
    assert m.bytes == 3 * 9 + 2 + 9 and len(m) == 4
    assert m.newest(b"k", 0) is None and m.newest(b"k", 8) == (4, 2, None) and m.newest(b"k", 99)[2] == b"b" and m.newest(b"q", 9) is None
    assert [r[1] for r in m.rows()] == [5, 9, 4, 1] and [r[0] for r in m.rows(b"k")] == [b"k"] * 3
    assert [r[1] for r in m.kept(3)] == [5, 9, 4, 1] and [r[1] for r in m.kept(4)] == [5, 9, 4] and [r[1] for r in m.kept(9)] == [5, 9]
    m.drop(4)
    assert len(m) == 2 and m.bytes == 10 + 9


def test_switches_filters_cache_and_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(memtable_bytes=200, block_cache_bytes=2000))
    for k in range(40):
        store.put(b"k%03d" % k, b"v%d" % k)
    s = store.stats()
    assert s["level_files"][0] >= 2 and s["memtable_bytes"] < 200 and s["memtable_versions"] > 0 and s["flush_bytes"] > 0 and s["user_bytes"] == sum(4 + len("v%d" % k) for k in range(40))
    assert [store.get(b"k%03d" % k) for k in (0, 1, 39)] == [b"v0", b"v1", b"v39"]
    read = store.stats()["block_reads"]
    assert read == 2  # the last one is not in a file yet
    assert store.get(b"k000") == b"v0" and store.stats()["block_reads"] == read and store.stats()["cache_hits"] == 1
    for k in range(200):
        assert store.lookups.absent(1, b"k000x%d" % k) in (True, False)
    s = store.stats()
    assert s["filter_negatives"] > 180 and 0 < s["cache_bytes"] <= 2000
    assert store.get(b"k001x") is None and store.get(b"nothing") is None
    off = Store(spark, str(tmp_path / "t"), Options(memtable_bytes=100, block_cache_bytes=0, bloom_bits_per_key=0))
    for k in range(20):
        off.put(b"k%03d" % k, b"v")
    assert off.get(b"k000") == off.get(b"k000") == b"v"
    assert off.stats()["cache_hits"] == 0 and off.stats()["filter_negatives"] == 0 and off.stats()["block_reads"] == 2 and not off.files.list("filters")


def test_backpressure_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(memtable_bytes=1, l0_compaction_trigger=2, l0_slowdown=3, l0_stop=4))
    for k in range(7):
        store.put(b"k", b"%d" % k)
    s = store.stats()
    assert s["slowdowns"] >= 2 and s["stalls"] >= 1 and s["stall_micros"] > 0 and s["level_files"][0] <= 4
    assert store.get(b"k") == b"6"


def test_checkpoints_and_trimming(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, Options(checkpoint_every=5, retain_versions=2))
    for k in range(17):
        store.put(b"k%02d" % (k % 6), b"%d" % k)
    want = pairs(store.iter())
    assert sum(n.endswith(".checkpoint") for n in store.files.list("log")) == 3
    store.vacuum()
    left = store.files.list("log")
    assert sum(n.endswith(".json") for n in left) == 5 and sum(n.endswith(".checkpoint") for n in left) == 1
    again = Store(spark, path)
    assert pairs(again.iter()) == want and again.state.last_seq == 17 and len(again.state.memtable) == 17
    store.files.write("log/" + next(n for n in left if n.endswith(".checkpoint")), b"torn")
    with pytest.raises(Corruption):  # a gap
        Store(spark, path)


def _log_bytes(store, suffix):
    return sum(store.files.size(f"log/{n}") for n in store.files.list("log") if n.endswith(suffix))


def test_checkpoints_of_many_unflushed_versions_build_on_each_other(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, Options(sync="periodic", sync_ms=10**9, checkpoint_every=4, retain_versions=2, memtable_bytes=1 << 40))
    want = {}
    for k in range(200):
        key, value = b"k%03d" % (k % 150), b"%d" % k + b"x" * 40_000
        store.put(key, value)
        want[key] = value
    assert len(store.state.memtable) == 200
    assert _log_bytes(store, ".checkpoint") < 2 * _log_bytes(store, ".json")  # each held all versions up to it
    same = lambda s: len(s.state.memtable) == 200 and s.multi_get(list(want)) == list(want.values())
    assert same(Store(spark, path))
    points = [n for n in store.files.list("log") if n.endswith(".checkpoint")]
    middle = points[-5]
    kept = store.files.read(f"log/{middle}")
    store.files.write(f"log/{middle}", kept[:-1])
    assert same(Store(spark, path))  # the one before, and the commits since
    store.files.write(f"log/{middle}", store.files.read(f"log/{points[-6]}"))
    assert same(Store(spark, path))  # whole, but not what the next one builds on
    store.files.write(f"log/{middle}", kept)
    store.vacuum()
    assert sum(n.endswith(".json") for n in store.files.list("log")) < 10
    again = Store(spark, path, store.options)
    assert same(again)
    for k in range(8):  # goes on from there
        again.put(b"new", b"%d" % k)
    assert Store(spark, path).get(b"new") == b"7" and len(Store(spark, path).state.memtable) == 208
    again.flush()
    for k in range(8):
        again.put(b"newer", b"%d" % k)
    again.vacuum()
    last = Store(spark, path)
    assert sum(n.endswith(".checkpoint") for n in last.files.list("log")) == 1
    assert len(last.state.memtable) < 10 and last.get(b"newer") == b"7" and last.get(b"k000") == want[b"k000"]


def test_recovery_with_checkpoints_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("palimpsest.store.log.GROUP_BYTES", 20)
    test_recovered_is_durable_and_a_prefix(spark, tmp_path)


def test_two_writers_flush(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = Store(spark, path), Store(spark, path)
    one.put(b"a", b"1")
    two.put(b"b", b"2")
    one.flush()  # takes in the other's write first
    assert not len(one.state.memtable) and len(two.state.memtable) == 2
    two.put(b"c", b"3")
    assert len(two.state.memtable) == 1 and pairs(two.iter()) == {b"a": b"1", b"b": b"2", b"c": b"3"}
    stale = two.transaction()
    stale.put(b"a", b"x")
    one.refresh()
    one.put(b"a", b"9")
    one.flush()
    with pytest.raises(Conflict):
        stale.commit()


def test_frame_above_unflushed_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(b"k", b"old")
    gone = spark.createDataFrame([(0, 2, bytearray(b"k"), None)], "op_index long, kind int, key binary, value binary")
    assert store.write_frame(gone) == 1 and store.get(b"k") is None
    store.compact_all()
    assert store.get(b"k") is None and store.iter().count() == 0
    assert store.write_frame(gone.limit(0)) == 0
    assert not [n for n in store.files.list("data") if n.startswith("staged")]


def test_plain_scans_after_a_full_compaction(spark, tmp_path):
    store, model, rnd = Store(spark, str(tmp_path / "s"), Options(memtable_bytes=200, target_file_bytes=150)), {}, random.Random(5)
    for _ in range(40):
        batch = random_batch(rnd)
        store.write(batch)
        model = after(model, batch)
    store.compact_all()
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert len(store.state.files) > 1 and "Window" not in plan(store.scan()) and "Exchange" not in plan(store.scan())
    assert pairs(store.scan()) == model
    wanted = spark.createDataFrame([(n, bytearray(b"k%03d" % (n % 40))) for n in range(80)], "pos long, key binary")
    look = lambda: {r["pos"]: r["value"] and bytes(r["value"]) for r in store.multi_get_frame(wanted).collect()}
    assert look() == {n: model.get(b"k%03d" % (n % 40)) for n in range(80)}
    store.put(b"k000", b"again")  # now versions need a choice
    assert "Window" in plan(store.scan()) and pairs(store.scan()) == model | {b"k000": b"again"} and look()[0] == b"again"
    with store.snapshot():
        store.put(b"k001", b"x"), store.put(b"k001", b"y")
        store.compact_all()
        assert pairs(store.scan()) == model | {b"k000": b"again", b"k001": b"y"}
    again = Store(spark, store.path)
    again.compact_all()
    assert pairs(again.scan()) == model | {b"k000": b"again", b"k001": b"y"}


def test_raw_round_trip(spark, tmp_path):
    rnd, model = random.Random(3), {}
    store = Store(spark, str(tmp_path / "s"), Options(memtable_bytes=400))
    for _ in range(60):
        batch = random_batch(rnd)
        store.write(batch)
        model = after(model, batch)
    store.compact_level(0)
    store.put(b"last", b"one")
    dump(store, str(tmp_path / "raw"))
    model[b"last"] = b"one"
    back = recover(spark, str(tmp_path / "raw"), str(tmp_path / "t"))
    assert pairs(back.iter()) == model and back.state.last_seq == store.state.last_seq
    assert back.stats()["level_files"][1:] == store.stats()["level_files"][1:]
    assert contents(spark, str(tmp_path / "raw") + "/*.sst").count() == sum(f["entry_count"] for f in store.state.files.values())
    back.put(b"more", b"1")
    assert back.get(b"more") == b"1" and back.state.last_seq == store.state.last_seq + 1
    with pytest.raises(InvalidArgument):
        recover(spark, str(tmp_path / "raw"), str(tmp_path / "t"))


def test_raw_logs_torn_and_damaged(spark, tmp_path):
    raw = Files(spark, str(tmp_path / "raw"))
    one = wal.encode(1, [(1, b"a", b"1"), (1, b"b", b"2")]) + wal.encode(3, [(2, b"a", None)])
    two = wal.encode(4, [(1, b"c", b"3")])
    torn = wal.encode(5, [(1, b"d", b"4")])[:-2]
    head = manifest.encode([("FORMAT", 5, None)])
    raw.write("MANIFEST", head + manifest.encode([("LOGNUM", 3, None), ("LASTSEQ", 2, None)]))
    raw.write("000002.log", wal.encode(1, [(1, b"old", b"x")]))  # below the log number
    raw.write("000003.log", one)
    raw.write("000004.log", two + torn)
    raw.write("000009.sst", b"an orphan")
    raw.write("note.tmp", b"")
    got = recover(spark, raw.root, str(tmp_path / "t"))
    assert pairs(got.iter()) == {b"b": b"2", b"c": b"3"} and got.state.last_seq == 4
    raw.write("000003.log", one[:-1])
    with pytest.raises(Corruption):
        recover(spark, raw.root, str(tmp_path / "u"))
    raw.write("000003.log", one)
    raw.write("MANIFEST", head + manifest.encode([("ADD", 7, 1)]))
    with pytest.raises(Corruption):
        recover(spark, raw.root, str(tmp_path / "v"))
    with pytest.raises(InvalidArgument):
        recover(spark, str(tmp_path / "nowhere"), str(tmp_path / "w"))


def test_shell(spark, tmp_path):
    said = []
    store = Store(spark, str(tmp_path / "s"))
    Shell(store, said.append).run(["put a 1", "snap", "put b 2", "del a", "get a", "sget a", "scan", "sscan", "scan a b", "unsnap", "sget a", "flush", "compact", "what", "put a", "", "stats", "quit", "put z 1"])
    text = "\n".join(said)
    assert text.startswith("OK\nsnapshot at seq 1\nOK\nOK\n(nil)\n1\nb = 2\n(1 keys)\na = 1\n(1 keys)\n(0 keys)\nOK\nno snapshot (use snap)\nOK\nOK\nunknown command\nunknown command\n")
    assert "last_sequence: 3" in text and store.get(b"z") is None and not store.snapshots
