"""Encoding operators against the tokenizers library, text by text."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import bpe_chunks, packing, token_store
from palimpsest.llm.tokens import ByteRanks, PieceEncoder, load, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path, texts):
    tok = load(path)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "b ", " ", "\n", "é", "'s", "日", " the", "1", "!!", "<|endoftext|>", "  ", "\t", "\r\n", "́", " Σ", "\x01", "word " * 40, ".", ",", "ABC", "<|ENDOFTEXT|>"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 600))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_piece_encoder_is_the_library(path, edge_rows):
    texts = [r[1] for r in edge_rows] + random_texts(60, 1) + ["Only ASCII, In Upper CASE.\nAnd <|ENDOFTEXT|> too", "PLAIN Words " * 9, "J\u030c H\u0331 \u0130 \u03a3\u03a3"]
    enc = PieceEncoder(path, limit=50)  # a tiny memo starts afresh again and again
    want = [packed(x) for x in library(path, texts)]
    assert enc.encode(texts) == want
    assert [enc.encode([t])[0] for t in texts] == want


def test_chunks_are_content_defined():
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)).encode()
    shared = words(3000)
    one, two = bpe_chunks.chunk([words(70) + shared, words(900) + shared])
    assert b"".join(one).endswith(shared)
    assert len(set(one) & set(two)) > 0.8 * len(one) - 3
    assert max(map(len, one)) <= bpe_chunks.MOST
    for c in bpe_chunks.chunk(["é日".encode() * 4000])[0]:
        c.decode()


def test_chunk_encoder_is_the_library(edge_rows):
    texts = [r[1] or "" for r in edge_rows] + [t * 20 for t in random_texts(40, 3)]
    enc = bpe_chunks.ChunkEncoder(BYTE, memo_bytes=20000)
    found = [list(x) for x in enc.encode([t.encode() for t in texts])]
    assert found == library(BYTE, texts)
    assert enc.encoded and enc.reused
    tok = load(BYTE)
    assert [enc.decode(x) for x in enc.encode([t.encode() for t in texts])] == [tok.decode(x, skip_special_tokens=False) for x in found]


def test_rank_encoder_is_the_library(edge_rows):
    texts = [r[1] or "" for r in edge_rows] + random_texts(60, 5) + ["a" * 50000, " " * 3000 + "x", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>"]
    ranks = ByteRanks(BYTE)
    assert [list(ranks.encode(t.encode())) for t in texts] == library(BYTE, texts)
    with pytest.raises(ValueError):
        ByteRanks(WORD)


def test_long_runs_without_blanks():
    rnd = random.Random(9)
    run = "".join(rnd.choice("abcdefgh0!") for _ in range(40000))
    texts = [run, "one two three four " + run + " five six seven eight " * 100 + run, "é" * 9000 + " x y z w " * 300, "日 本 " * 4000]
    assert len(bpe_chunks.chunk([run.encode()])[0]) == 1
    enc = bpe_chunks.ChunkEncoder(BYTE)
    assert [list(x) for x in enc.encode([t.encode() for t in texts])] == library(BYTE, texts)


def test_marks_do_not_depend_on_the_block(monkeypatch):
    body = " ".join(random_texts(40, 6)).encode()
    whole = bpe_chunks.chunk([body])
    monkeypatch.setattr(bpe_chunks, "BLOCK", 100)
    assert bpe_chunks.chunk([body]) == whole


def test_op1(spark, documents, edges, nothing):
    for frame in (documents, edges):
        rows = frame.select("doc_id", "text").collect()
        got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe_chunks.encode_documents(frame, BYTE).collect())
        want = library(BYTE, [r["text"] for r in rows])
        assert got == Counter((r["doc_id"], len(x), packed(x), r["text"] or "") for r, x in zip(rows, want))
    assert bpe_chunks.encode_documents(nothing, BYTE).count() == 0


def test_op1_query(spark, sf_dir):
    from palimpsest.llm.queries import queries

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries()["op1_bpe_chunk_reuse"](spark, sf_dir).collect()}
    for r, ids in zip(rows, library(BYTE, [r["text"] for r in rows])):
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def check_packing(rows, pieces, end_id=1):
    want = Counter()
    for r, ids in zip(rows, library(WORD, [r["text"] for r in rows])):
        want[r["doc_id"], packed(ids + [end_id])] += 1
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_length"]))
        docs[p["doc_id"], p["doc_tokens"]].append((p["start"], bytes(p["ids"])))
    for s in sequences.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at == s[0][2] <= packing.CAPACITY
    total = Counter()
    for (doc, size), own in docs.items():
        own.sort()
        for start in sorted({s for s, _ in own}):
            total[doc] += 1
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) // 4 * n for k, n in want.items())
    return sequences, docs, want


def test_op7(spark, documents, edges, nothing):
    rows = documents.select("doc_id", "text").collect()
    pieces = packing.pack_documents(documents, WORD).collect()
    sequences, docs, want = check_packing(rows, pieces)
    for (doc, body), _ in want.items():
        own = sorted(docs[doc, len(body) // 4])
        assert b"".join(b for _, b in own) == body and [s for s, _ in own] == [sum(len(b) // 4 for _, b in own[:k]) for k in range(len(own))]
    filled = sum(s[0][2] for s in sequences.values())
    assert filled / (len(sequences) * packing.CAPACITY) > 0.95
    check_packing(edges.select("doc_id", "text").collect(), packing.pack_documents(edges, WORD).collect())
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_differencing():
    rnd = random.Random(4)
    for _ in range(60):
        sizes = [rnd.randrange(1, 2048) for _ in range(rnd.randrange(1, 80))]
        found = packing.windows_for(sizes)
        assert sorted(n for w in found for n in w) == list(range(len(sizes)))
        assert all(sum(sizes[n] for n in w) <= packing.CAPACITY for w in found)
    assert packing.windows_for([]) == []
    # the textbook case: differencing gives 16 and 14 for two windows
    assert sorted(sum([8, 7, 6, 5, 4][n] for n in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_least_window_count():
    for size, copies, least in [(250, 525, 66), (400, 328, 66), (480, 273, 69), (500, 263, 66)]:
        assert len(packing.windows_for([size] * copies)) == least
    rnd = random.Random(8)
    for _ in range(20):
        sizes = [rnd.choice([rnd.randrange(1, 513), 400, 500]) for _ in range(60)]
        k = len(packing.windows_for(sizes))
        for fewer in range(-(-sum(sizes) // packing.CAPACITY), k):
            assert max(sum(sizes[n] for n in w) for w in packing.difference(sizes, fewer)) > packing.CAPACITY


def test_directly_addressable_codes():
    rnd = random.Random(6)
    for _ in range(12):
        lengths = [rnd.randrange(0, 900) for _ in range(rnd.randrange(1, 9))]
        ids = [rnd.choice([0, 5, 255, 256, 50256, 65536, 2**24, 2**32 - 1, rnd.randrange(50000)]) for _ in range(sum(lengths))]
        names = [rnd.choice([None, -3, 2**60, k]) for k in range(len(lengths))]
        s = token_store.Shard(token_store.build(names, lengths, packed(ids)))
        assert [int(n) if k else None for n, k in zip(s.doc_ids, s.known)] == names
        assert s.tokens(0, len(ids)).tolist() == ids
        for _ in range(40):
            if ids:
                i = rnd.randrange(len(ids))
                j = rnd.randrange(i, len(ids) + 1)
                assert s.token(i) == ids[i] and s.tokens(i, j).tolist() == ids[i:j]
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 40)


def test_op8(spark, documents, edges, nothing):
    for frame, shard in ((documents, 20000), (documents, 1 << 22), (edges, 100)):
        shards = token_store.write_tokens(frame, BYTE, shard_tokens=shard)
        docs = token_store.with_global_start(token_store.read_tokens(shards), shards)
        rows = frame.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], packed(x + [0])) for r, x in zip(rows, library(BYTE, [r["text"] for r in rows])))
        found = sorted(docs.collect(), key=lambda r: r["start"])
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == want
        at, last = 0, None
        for r in found:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
            assert last is None or last[0] is None or last[0] <= r["doc_id"]
            at, last = at + r["n_tokens"], (r["doc_id"],)
    empty = token_store.write_tokens(nothing, BYTE)
    assert token_store.with_global_start(token_store.read_tokens(empty), empty).count() == 0


def test_crc_of_ids_is_over_little_endian_words(spark):
    from pyspark.sql import functions as F

    body = packed([1, 70000, 2])
    assert spark.createDataFrame([(bytearray(body),)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(body)


def test_op7_query(spark, sf_dir):
    from palimpsest.llm.queries import queries

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r["doc_id"]: ids + [1] for r, ids in zip(rows, library(WORD, [r["text"] for r in rows]))}
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in queries()["op7_packing"](spark, sf_dir).collect():
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(ids) == p["length"] > 0 and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(packed(ids))
        docs[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert docs.keys() == want.keys()
    for own, whole in [(docs[i], len(x)) for i, x in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at <= 2048 if whole is None else at == whole


def test_op8_query(spark, sf_dir):
    from palimpsest.llm.queries import queries

    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries()["op8_token_store"](spark, sf_dir).collect()}
    at = 0
    assert len(got) == len(rows)
    for r, ids in zip(rows, library(BYTE, [r["text"] for r in rows])):
        ids = ids + [0]
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)


def test_chunks_of_neighbours_are_encoded_once():
    """Documents that share a passage, one after the other: it is found in the memo."""
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = words(2000)
    enc = bpe_chunks.ChunkEncoder(BYTE)
    for k in range(6):
        text = words(50) + " " + shared + " " + words(50)
        assert [list(x) for x in enc.encode([text.encode()])] == library(BYTE, [text])
    assert enc.reused > 0.6 * (enc.reused + enc.encoded)
