"""Raw layouts and wire requests: round trips, damage, corruption."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import Corruption, InvalidArgument, ProtocolError
from palimpsest.functions import bloom
from palimpsest.functions.glob import like, match
from palimpsest.functions.integers import parse as parse_int
from palimpsest.operators.files import live_files
from palimpsest.sources import manifest, resp, table, wal
from palimpsest.store.log import Files


def test_wal_round_trip_and_torn_tail():
    one, two, three = wal.encode(1, [(1, b"a", b"x")]), wal.encode(2, [(1, b"b", b""), (2, b"a", None)]), wal.encode(4, [(2, b"", None)])
    data = one + two + three
    want = [(b"a", 1, 1, b"x"), (b"b", 2, 1, b""), (b"a", 3, 2, None), (b"", 4, 2, None)]
    assert wal.replay(data) == (want, len(data))
    for cut in range(len(one) + len(two), len(data)):
        assert wal.replay(data[:cut])[0] == want[:3]
    assert wal.replay(data[: len(one) + 5])[0] == want[:1]
    assert wal.replay(data + b"\0" * 40)[0] == want
    for k in range(len(one)):
        spoilt = bytearray(data)
        spoilt[k] ^= 1
        try:
            rows, _ = wal.replay(bytes(spoilt))
            assert rows == []  # a length now reaches past the end: nothing follows
        except Corruption:
            pass
    last = bytearray(data)
    last[len(one) + 30] ^= 1  # in the payload of a record that has another one after it
    with pytest.raises(Corruption):
        wal.replay(bytes(last))


def test_manifest_groups():
    data = manifest.encode([("FORMAT", 5, None)]) + manifest.encode([("ADD", 1, 0), ("LASTSEQ", 9, None)]) + manifest.encode([("REMOVE", 1, None), ("ADD", 2, 1)])
    want = [(0, "FORMAT", 5, None), (1, "ADD", 1, 0), (2, "LASTSEQ", 9, None), (3, "REMOVE", 1, None), (4, "ADD", 2, 1)]
    assert manifest.replay(data) == want
    for cut in range(1, 39):  # a torn group is left out whole
        assert manifest.replay(data[:-cut]) == want[:3]
    spoilt = bytearray(data)
    spoilt[20] ^= 4
    with pytest.raises(Corruption):
        manifest.replay(bytes(spoilt))
    with pytest.raises(Corruption):
        manifest.replay(manifest.encode([("ADD", 1, 0)]))


def test_long_manifest_is_replayed_in_one_pass():
    import time

    edits = [("REMOVE", k, None) if k % 3 == 0 else ("ADD", k, k % 7) for k in range(200_000)]
    data = manifest.encode([("FORMAT", 5, None)]) + b"".join(manifest.encode(edits[k : k + 50_000]) for k in range(0, len(edits), 50_000))
    began = time.process_time()
    assert manifest.replay(data)[1:] == [(k + 1, *e) for k, e in enumerate(edits)]
    assert time.process_time() - began < 5  # the rest of the file was copied at every record
    flipped = bytearray(data)
    flipped[13 * 150_000] ^= 1
    with pytest.raises(Corruption, match=str(13 * 150_000)):
        manifest.replay(flipped)
    torn = manifest.replay(data[:-9] + b"\x01" * 9 + bytes(200_000))  # a bad last record before a tail of zeros
    assert [e[1:] for e in torn[1:]] == edits[:150_000]


def test_manifest_pieces(spark, tmp_path):
    edits = spark.range(2_501).selectExpr("id * 3 as pos", "if(id % 4 = 0, 'REMOVE', 'ADD') as op", "id % 90 as id", "cast(if(id % 4 = 0, null, id % 7) as int) as level").repartition(7)
    want = [(k + 1, r["op"], r["id"], r["level"]) for k, r in enumerate(edits.orderBy("pos").collect())]
    Files(spark, str(tmp_path)).write_pieces("MANIFEST", manifest.pieces(edits, 100))
    data = (tmp_path / "MANIFEST").read_bytes()
    assert manifest.replay(data) == [(0, "FORMAT", 5, None), *want]
    assert len(data) < 13 * (1 + 2_501 + 26 + 10)  # one header for a hundred edits, and for what is left of a partition
    assert [tuple(r) for r in manifest.read(spark, str(tmp_path)).orderBy("pos").collect()][1:] == want
    last = {i: (op, level) for _, op, i, level in want}
    assert {tuple(r) for r in live_files(manifest.read(spark, str(tmp_path))).collect()} == {(i, level) for i, (op, level) in last.items() if op == "ADD"}
    with pytest.raises(Exception, match="no manifest can hold"):
        list(manifest.pieces(edits.withColumn("level", F.lit(7))))


@pytest.mark.parametrize("seed", range(4))
def test_table_model(seed):
    rnd = random.Random(seed)
    versions = {}
    for seq in range(1, 400):
        key = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(5)))
        versions[key, seq] = None if rnd.random() < 0.2 else bytes(rnd.randrange(256) for _ in range(rnd.randrange(30)))
    w = table.TableWriter(block_bytes=rnd.randrange(32, 600))
    order = sorted(versions, key=lambda x: (x[0], -x[1]))
    for key, seq in order:
        w.add(key, seq, versions[key, seq])
    with pytest.raises(InvalidArgument):
        w.add(order[-1][0], order[-1][1], b"")
    data = w.finish()
    t = table.Table(data)
    assert [(k, s) for k, s, _ in t.entries()] == order
    for _ in range(200):
        key, at = bytes(rnd.choice(b"abcde") for _ in range(rnd.randrange(5))), rnd.randrange(420)
        found = max((s for k, s in versions if k == key and s <= at), default=None)
        assert t.get(key, at) == (None if found is None else (found, versions[key, found]))
    for cut in rnd.sample(range(len(data)), 60):
        with pytest.raises(Corruption):
            table.Table(data[:cut])
    for at in [*range(len(data) - 52, len(data)), *rnd.sample(range(len(data)), 60)]:
        spoilt = bytearray(data)
        spoilt[at] ^= 1 << rnd.randrange(8)
        with pytest.raises(Corruption):
            list(table.Table(bytes(spoilt)).entries())


def test_bloom():
    keys = [b"key%06d" % k for k in range(4000)]
    f = bloom.build(keys)
    assert bloom.test(f, keys).all()
    assert bloom.test(f, [k + b"x" for k in keys]).mean() < 0.02
    with pytest.raises(Corruption):
        bloom.test(f[:-1] + bytes([f[-1] ^ 1]), keys)
    plain = 0xCBF29CE484222325
    for b in b"abc":
        plain = (plain ^ b) * 0x100000001B3 % (1 << 64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        plain = (plain ^ plain >> 33) * factor % (1 << 64)
    assert int(bloom.hashes([b"abc"])[0]) == plain ^ plain >> 33


def test_spark_readers(spark, tmp_path):
    h = spark.createDataFrame([(b"a", 2, 1, b"x"), (b"a", 1, 2, None), (b"b", 3, 1, b"")], "key binary, seq long, kind int, value binary")
    (tmp_path / "wal").mkdir(), (tmp_path / "sst").mkdir(), (tmp_path / "m").mkdir()
    for r in wal.files(h).collect():
        (tmp_path / "wal" / r["file"]).write_bytes(r["content"])
    for r in table.files(h, 2).collect():
        (tmp_path / "sst" / f"{r['part']}.sst").write_bytes(r["content"])
    (tmp_path / "m" / "MANIFEST").write_bytes(manifest.encode([("FORMAT", 5, None)]) + manifest.encode([("ADD", 3, 1)]))
    want = {(bytes(r[0]), r[1], r[2], r[3]) for r in h.collect()}
    for found in (wal.read(spark, str(tmp_path / "wal")), table.read(spark, str(tmp_path / "sst"))):
        assert {(bytes(r["key"]), r["seq"], r["kind"], r["value"]) for r in found.collect()} == want
    assert [tuple(r) for r in manifest.read(spark, str(tmp_path / "m")).orderBy("pos").collect()] == [(0, "FORMAT", 5, None), (1, "ADD", 3, 1)]
    stream = resp.request(b"SET", b"a", b"1") + b"get a\r\n\r\n" + b"*0\r\n*1\r\n$4\r\nPI"
    rows = resp.commands(spark.createDataFrame([(1, bytearray(stream))], "id long, data binary")).collect()
    assert [(r["pos"], r["name"], [bytes(a) for a in r["args"]]) for r in rows] == [(0, "SET", [b"a", b"1"]), (1, "GET", [b"a"])]


def test_requests():
    whole = resp.request(b"SET", b"k", b"a\r\nb")
    assert resp.parse(whole + b"x") == ([b"SET", b"k", b"a\r\nb"], len(whole))
    assert all(resp.parse(whole[:k]) is None for k in range(len(whole)))
    assert resp.parse(b"  PING   x \n") == ([b"PING", b"x"], 12)
    for bad in (b"*-1\r\n", b"*x\r\n", b"*1\r\n+a\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$1\r\nabc", b"*1048577\r\n", b"*1\r\n$67108865\r\n", b"a" * 70000):
        with pytest.raises(ProtocolError):
            resp.parse(bad)
    assert resp.encode(resp.error("a\r\nb")) == b"-a  b\r\n" and resp.encode(resp.NIL_ARRAY) == b"*-1\r\n"


def test_glob(spark):
    yes = [(b"*", b""), (b"*", b"abc"), (b"u?er", b"user"), (b"a*c", b"abbbc"), (b"a\\*", b"a*"), (b"", b""), (b"*a*b?", b"xxaxxbz"), (b"a\\", b"a\\"), (b"?", b"\xff"), (b"a*", b"a\n"), (b"[a]", b"[a]")]
    no = [(b"user:*", b"use"), (b"u?er", b"uer"), (b"a*c", b"ab"), (b"a\\*", b"ab"), (b"", b"x"), (b"*a*b?", b"xxaxxb"), (b"?", b"\xc3\xa9"), (b"a", b"a\n"), (b"[a]", b"a")]
    for want, cases in ((True, yes), (False, no)):
        for p, s in cases:
            assert match(p, s) is want, (p, s)
            frame = spark.createDataFrame([(bytearray(s),)], "key binary")
            assert frame.select(like(frame["key"], p)).first()[0] is want, (p, s)
    assert not match(b"*a*a*a*a*a*a*a*a*a*a*a*a*b", b"a" * 200)


def test_integers():
    good = {b"5": 5, b"+5": 5, b"-5": -5, b"007": 7, b"9223372036854775807": 2**63 - 1, b"-9223372036854775808": -(2**63)}
    assert all(parse_int(k) == v for k, v in good.items())
    assert all(parse_int(k) is None for k in (b"", b" 5", b"5 ", b"5\n", b"+", b"1.0", b"0x1", b"9223372036854775808", b"1_0"))
