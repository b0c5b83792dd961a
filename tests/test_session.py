"""Wire commands and their replies."""

import pytest

from palimpsest.sources import resp
from palimpsest.store import Store
from palimpsest.store.session import Session


@pytest.fixture
def session(spark, tmp_path):
    return Session(Store(spark, str(tmp_path / "s")))


def say(session, line):
    return session.run(*line.encode().split(b" "))


def text(reply):
    return resp.encode(reply).decode()


def test_plain_commands(session):
    assert text(say(session, "ping")) == "+PONG\r\n"
    assert text(say(session, "PING hi")) == "$2\r\nhi\r\n"
    assert text(say(session, "ECHO")) == "-ERR wrong number of arguments for 'echo' command\r\n"
    assert text(say(session, "APPEND a b")) == "-ERR unknown command 'APPEND'\r\n"
    assert text(say(session, "GET k")) == "$-1\r\n"
    assert text(say(session, "SET k v")) == "+OK\r\n"
    assert text(say(session, "SET k v EX 5")).startswith("-ERR SET options")
    assert text(say(session, "GET k")) == "$1\r\nv\r\n"
    assert text(say(session, "MSET a 1 b 2 a 3")) == "+OK\r\n"
    assert text(say(session, "MSET a 1 b")).startswith("-ERR wrong number")
    assert text(say(session, "MGET a zz b a")) == "*4\r\n$1\r\n3\r\n$-1\r\n$1\r\n2\r\n$1\r\n3\r\n"
    assert text(say(session, "EXISTS a a zz")) == ":2\r\n"
    assert text(say(session, "DEL a a zz")) == ":2\r\n"
    assert text(say(session, "DBSIZE")) == ":2\r\n"
    assert "last_sequence:" in text(say(session, "INFO"))
    assert session.run(b"QUIT") == resp.OK and session.closed


def test_counters(session):
    assert text(say(session, "INCR n")) == ":1\r\n"
    assert text(say(session, "INCRBY n 41")) == ":42\r\n"
    assert text(say(session, "DECR n")) == ":41\r\n"
    assert text(say(session, "INCRBY n x")) == "-ERR value is not an integer or out of range\r\n"
    say(session, "SET n 9223372036854775807")
    assert text(say(session, "INCR n")) == "-ERR increment or decrement would overflow\r\n"
    session.run(b"SET", b"n", b" 5 ")
    assert text(say(session, "INCR n")) == "-ERR value is not an integer or out of range\r\n"


def test_scan_keys_range(session):
    session.run(b"MSET", *[x for k in range(25) for x in (b"user:%03d" % k, b"%d" % k)], b"other", b"o")
    assert len(say(session, "KEYS user:*")[1]) == 25
    assert [b for _, b in say(session, "KEYS *:00?")[1]] == [b"user:%03d" % k for k in range(10)]
    assert text(say(session, "RANGE user:003 user:005")) == "*4\r\n$8\r\nuser:003\r\n$1\r\n3\r\n$8\r\nuser:004\r\n$1\r\n4\r\n"
    assert len(say(session, "RANGE a z LIMIT 3")[1]) == 6
    assert say(session, "RANGE a z LIMIT 0")[1] == []
    assert text(say(session, "RANGE a z LIMIT -1")) == "-ERR LIMIT must be a non-negative integer\r\n"
    assert text(say(session, "RANGE a z LIM 1")) == "-ERR syntax error\r\n"
    cursor, seen, pages = b"0", [], 0
    while True:
        page = session.run(b"SCAN", cursor, b"MATCH", b"user:*", b"COUNT", b"7")[1]
        seen += [b for _, b in page[1][1]]
        cursor, pages = page[0][1], pages + 1
        if cursor == b"0":
            break
    assert seen == [b"user:%03d" % k for k in range(25)] and pages == 4
    for bad in ("SCAN x", "SCAN -1", "SCAN 0 COUNT 0", "SCAN 0 MATCH", "SCAN 0 WHAT 1"):
        assert say(session, bad)[0] == "error", bad
    assert say(session, "SCAN 1000")[1][0][1] == b"0"


def test_multi_exec_watch(session):
    other = Session(session.store)
    assert text(say(session, "EXEC")) == "-ERR EXEC without MULTI\r\n"
    assert say(session, "MULTI") == resp.OK
    assert say(session, "MULTI")[0] == "error" and say(session, "WATCH a")[0] == "error"
    assert text(say(session, "SET a 1")) == "+QUEUED\r\n"
    say(session, "INCR a"), say(session, "GET a"), say(session, "INCRBY a x"), say(session, "MGET a b")
    assert text(say(session, "EXEC")) == "*5\r\n+OK\r\n:2\r\n$1\r\n2\r\n-ERR value is not an integer or out of range\r\n*2\r\n$1\r\n2\r\n$-1\r\n"
    # a command that can't be queued spoils the whole
    say(session, "MULTI")
    assert say(session, "KEYS *")[0] == "error"
    assert text(say(session, "EXEC")).startswith("-EXECABORT")
    # a watched key that changed aborts, also by one's own hand
    say(session, "WATCH a")
    say(other, "SET a 5")
    say(session, "MULTI"), say(session, "SET b 1")
    assert say(session, "EXEC") == resp.NIL_ARRAY and say(session, "GET b") == resp.NIL
    say(session, "WATCH a"), say(session, "SET a 6"), say(session, "MULTI"), say(session, "SET b 1")
    assert say(session, "EXEC") == resp.NIL_ARRAY
    say(session, "WATCH a"), say(session, "UNWATCH"), say(other, "SET a 7"), say(session, "MULTI"), say(session, "SET b 1")
    assert say(session, "EXEC")[0] == "array"
    say(session, "MULTI"), say(session, "SET b 2")
    assert say(session, "DISCARD") == resp.OK and say(session, "GET b") == resp.bulk(b"1")
    assert not session.store.snapshots


def test_over_a_socket(session):
    import socket
    import threading

    from palimpsest.store.server import Server

    with Server(session.store, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address, timeout=60) as c:
            c.sendall(resp.request(b"SET", b"k", b"v") + b"get k\r\n\r\n" + resp.request(b"QUIT"))
            got = b""
            while part := c.recv(4096):
                got += part
        with socket.create_connection(server.server_address, timeout=60) as c:
            c.sendall(b"*x\r\n")
            assert c.recv(4096).startswith(b"-ERR Protocol error")
        server.shutdown()
    assert got == b"+OK\r\n$1\r\nv\r\n+OK\r\n"
