"""The persistent store: batches, snapshots, transactions, maintenance, recovery."""

import random
import threading

import pytest

from palimpsest.config import Options
from palimpsest.errors import Conflict, Corruption, InvalidArgument
from palimpsest.store import Store
from palimpsest.store.log import Log, encode
from palimpsest.store.store import WriteBatch


def pairs(frame):
    return {bytes(r["key"]): bytes(r["value"]) for r in frame.collect()}


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        yield s


def test_batches_snapshots_and_deletes(store):
    store.write(WriteBatch())
    assert store.state.last_seq == 0
    store.write(WriteBatch().put(b"a", b"1").put(b"b", b"").delete(b"nope").put(b"a", b"2"))
    assert store.state.last_seq == 4
    with store.snapshot() as snap:
        store.write(WriteBatch().delete(b"a").put(b"c", b"3"))
        assert snap.multi_get([b"a", b"b", b"c", b"a"]) == [b"2", b"", None, b"2"]
        assert pairs(snap.iter()) == {b"a": b"2", b"b": b""}
        store.compact_all()
        assert pairs(snap.iter()) == {b"a": b"2", b"b": b""}
        assert store.oldest_snapshot() == 4
    assert pairs(store.iter()) == {b"b": b"", b"c": b"3"}
    assert store.get(b"a") is None
    store.compact_all()
    assert {r["entry_count"] for r in store.files_frame().collect()} == {2}
    assert pairs(store.scan(b"b", b"c")) == {b"b": b""}
    assert store.vacuum() and pairs(store.iter()) == {b"b": b"", b"c": b"3"}


def test_transactions(store):
    store.put(b"x", b"1")
    one, two = store.transaction(), store.transaction()
    one.put(b"x", b"2")
    assert one.get(b"x") == b"2" and two.get(b"x") == b"1"
    assert pairs(one.scan()) == {b"x": b"2"}
    one.commit()
    two.put(b"x", b"3")
    with pytest.raises(Conflict):
        two.commit()
    # a lock alone is checked too; plain reads are not
    three, four = store.transaction(), store.transaction()
    three.get_for_update(b"x")
    four.get(b"x")
    store.put(b"x", b"9")
    with pytest.raises(Conflict):
        three.commit()
    four.put(b"y", b"1")
    four.commit()
    gone = store.transaction()
    gone.delete(b"x")
    gone.rollback()
    assert pairs(store.iter()) == {b"x": b"9", b"y": b"1"}
    assert not store.snapshots


def test_write_skew_needs_locks(store):
    store.write(WriteBatch().put(b"a", b"1").put(b"b", b"1"))
    one, two = store.transaction(), store.transaction()
    one.get(b"b"), two.get(b"a")
    one.put(b"a", b"0"), two.put(b"b", b"0")
    one.commit(), two.commit()
    assert pairs(store.iter()) == {b"a": b"0", b"b": b"0"}
    one, two = store.transaction(), store.transaction()
    one.get_for_update(b"b"), two.get_for_update(b"a")
    one.put(b"a", b"1"), two.put(b"b", b"1")
    one.commit()
    with pytest.raises(Conflict):
        two.commit()


def test_frame_commit_numbers_in_order(spark, store):
    ops = spark.range(1000).selectExpr("id as op_index", "if(id % 5 = 0, 2, 1) as kind", "cast(concat('k', id % 100) as binary) as key", "if(id % 5 = 0, null, cast(id as string)) as value")
    assert store.write_frame(ops) == 1000
    assert store.state.last_seq == 1000
    got = pairs(store.iter())
    assert got == {b"k%d" % (k % 100): b"%d" % k for k in range(900, 1000) if k % 5}


def test_reopen_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = Store(spark, path), Store(spark, path)
    one.put(b"a", b"1")
    two.put(b"b", b"2")  # loses the race for the version, takes the other's commit in, tries again
    assert pairs(two.iter()) == {b"a": b"1", b"b": b"2"}
    one.refresh()
    assert pairs(one.iter()) == pairs(two.iter()) and one.state.last_seq == 2
    again = Store(spark, path)
    assert again.state.last_seq == 2 and pairs(again.iter()) == pairs(one.iter())


def test_damaged_commits(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store(spark, path)
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    last = s.files.list("log")[-1]
    whole = s.files.read(f"log/{last}")
    s.files.write(f"log/{last}", whole[:-3])
    cut = Store(spark, path)
    assert pairs(cut.iter()) == {b"a": b"1"}
    first = s.files.list("log")[0]
    s.files.write(f"log/{first}", b"00000000\n{}")
    with pytest.raises(Corruption):
        Store(spark, path)


def test_log_rejects_bad_edits(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for edits in ([{"op": "REMOVE", "id": 7}], [{"op": "FORMAT", "id": 5}], [{"op": "WHAT"}]):
        s.files.write("log/00000000000000000002.json", encode(2, edits))
        with pytest.raises(Corruption):
            Log(s.files).replay()
    assert s.log.edits(spark).count() >= 1


def test_levels_move_and_skip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(target_file_bytes=400, l0_compaction_trigger=2, level1_max_bytes=1000, level_multiplier=2))
    for k in range(4):
        s.write(WriteBatch())
        b = WriteBatch()
        for n in range(10):
            b.put(b"k%02d" % (k * 10 + n), b"v" * 20)
        s.write(b)
        s.flush()
    assert s.pick_level() == 0
    s.compact_level(0)  # disjoint files move by metadata alone
    assert s.stats()["level_files"][:2] == [0, 4] and s.stats()["compaction_bytes"] == 0
    s.put(b"k15", b"new")
    s.flush()
    s.compact()
    got = pairs(s.iter())
    assert len(got) == 40 and got[b"k15"] == b"new"
    s.scan(b"k00", b"k01").collect()
    assert s.stats()["files_skipped"] > 0
    assert s.compact() == 0 and sum(s.stats()["level_files"]) == s.stats()["tables"]
    Store(spark, s.path)


def test_counter_threads_lose_nothing(spark, store):
    from palimpsest.store.session import Session

    def work():
        session = Session(store)
        for _ in range(4):
            assert session.run(b"INCR", b"n")[0] == "int"

    threads = [threading.Thread(target=work) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.get(b"n") == b"12"


def test_against_a_model(spark, tmp_path):
    rnd = random.Random(11)
    path = str(tmp_path / "s")
    s = Store(spark, path, Options(memtable_bytes=40, target_file_bytes=200, l0_compaction_trigger=2, l0_slowdown=3, l0_stop=4))
    model, held = {}, []
    for _ in range(40):
        op = rnd.choices(["batch", "snapshot", "release", "compact", "reopen", "all"], [60, 12, 6, 8, 5, 5])[0]
        if op == "batch":
            b = WriteBatch()
            for _ in range(rnd.randrange(4)):
                key = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(3)))
                if rnd.random() < 0.7:
                    value = bytes(rnd.randrange(256) for _ in range(rnd.randrange(5)))
                    b.put(key, value)
                    model[key] = value
                else:
                    b.delete(key)
                    model.pop(key, None)
            s.write(b)
        elif op == "snapshot":
            held.append((s.snapshot(), dict(model)))
        elif op == "release" and held:
            held.pop(rnd.randrange(len(held)))[0].release()
        elif op == "compact":
            s.compact()
        elif op == "all":
            s.compact_all()
        elif op == "reopen":
            [h[0].release() for h in held]
            held = []
            s = Store(spark, path, s.options)
    assert pairs(s.iter()) == model
    for snap, want in held:
        assert pairs(snap.iter()) == want
    s.vacuum()
    assert pairs(s.iter()) == model


def test_option_order():
    with pytest.raises(InvalidArgument):
        Options(l0_compaction_trigger=9)
