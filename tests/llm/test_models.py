"""Trained operators: held-out accuracy, folds, odd rows; the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, quality, toxicity
from palimpsest.llm.common import residue


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet").cache(), spark.read.parquet(f"{d}/labels.parquet").cache()


def test_residue(spark):
    got = spark.range(50).select("id", residue(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_language(spark, larger, edges, nothing):
    docs, _ = larger
    model = language.train(docs, residue(F.col("doc_id"), 3) != 1, per_language=300)
    held = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(residue(F.col("doc_id"), 3) == 1)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert (model.weights == 0).mean() > 0.3  # sparse
    got = language.identify(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by_id[k] == "und" for k in (0, 1, 2, 3, 9)) and by_id[4] != "und"
    assert language.identify(nothing, model).count() == 0
    kept = language.keep_identified(edges, model)
    assert kept.columns == edges.columns and kept.filter("doc_id in (0, 1, 2, 3, 9)").count() == 0
    none = language.train(nothing, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(edges, none).collect()} == {("und", 0.0)}


def test_grams_do_not_depend_on_neighbours():
    texts = ["abc", "", "Überall", None, "x" * 300, "日本語"]
    together, at = language.grams(texts)
    for k, t in enumerate(texts):
        alone, _ = language.grams([t])
        assert all((a == b[at[k] : at[k + 1]]).all() for a, b in zip(alone, together))


def test_ftrl_and_temperature():
    rnd = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        c = int(rnd.integers(3))
        at = np.unique(np.append(rnd.integers(0, 50, 5), 50 + c))
        rows.append((c, at, np.ones(len(at))))
    w, b = language.fit_ftrl(rows, 3, 60, l1=0.5)
    assert np.mean([np.argmax(x @ w[at] + b) == c for c, at, x in rows]) > 0.97 and (w == 0).mean() > 0.1
    z = rnd.normal(size=(4000, 3))
    p = np.exp(2.0 * z) / np.exp(2.0 * z).sum(axis=1, keepdims=True)
    y = np.array([rnd.choice(3, p=q) for q in p])
    assert abs(language.fit_temperature(6.0 * z, y) - 3.0) < 0.4


def test_toxicity(spark, larger, edges, nothing):
    docs, marks = larger
    model = toxicity.train(docs, marks, residue(F.col("doc_id"), 5) != 0, per_class=600)
    held = toxicity.score_toxicity(docs, model).join(marks, "doc_id").filter(residue(F.col("doc_id"), 5) == 0).withColumn("hit", F.col("score") >= 0.5)
    row = held.agg(F.avg(F.when(F.col("toxic") == 1, F.col("hit").cast("int"))), F.avg(F.when(F.col("toxic") == 0, F.col("hit").cast("int")))).first()
    assert row[0] > 0.75 and row[1] < 0.05
    got = toxicity.score_toxicity(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(edges, model)
    assert kept.columns == edges.columns
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.train(docs, marks.filter("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score_toxicity(edges, None).collect()} == {0.0}


def test_toxicity_scores_do_not_depend_on_the_batch():
    texts = ["you are a clown", "", "nothing here to see", None, "word " * 3000, "clown"] * 10
    model = toxicity.fit(["a clown here", "kind words here"] * 20, [1, 0] * 20, epochs=8)
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone) and alone[0] > alone[2]


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words, languages and thresholds that no row of the first sample shows."""
    from palimpsest.llm.common import keep_share

    draw, share = np.random.default_rng(3), 0.1
    sampled = {r[0] for r in spark.range(3000).filter(keep_share({1: share}, F.lit(1), F.col("id"))).collect()}
    words = {"en": ["bread", "river", "stone", "garden", "winter"], "xx": ["ulom", "treba", "okli", "vesna", "gorod"]}
    rows, marks = [], []
    for i in range(3000):
        toxic, lang = i % 2, "en" if i in sampled or i % 4 < 2 else "xx"
        text = [words[lang][k] for k in draw.integers(0, 5, 12)]
        if toxic:
            text[draw.integers(12)] = "clown" if i in sampled else "weasel"
        rows.append((i, " ".join(text), lang))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), per_class=150)
    assert {"en", "xx"} <= set(model.languages)
    logs = np.array([model.word_log[toxicity.pieces([w])[0, 0]] for w in words["xx"]])
    assert (logs.argmax(axis=1) == model.languages.index("xx")).all()
    score = model.scores([f"{a} {b} {w} {a}" for own in words.values() for a, b in zip(own, own[1:]) for w in ("weasel", "clown", a)])
    assert all((s >= 0.5) == (k % 3 < 2) for k, s in enumerate(score))


def test_toxicity_averages_replicas_and_counts_every_row(spark, documents, labels, monkeypatch):
    """Many replicas: the mean by hand, all rows and words counted, all rows calibrated."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 8)
    rows = documents.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").select("doc_id", "text", "lang", "toxic")
    start, names = toxicity.fit(["a clown here", "kind words here"], [1, 0], epochs=1), ["en", None]
    replicas = toxicity._replicas(rows, start, {0: 0.5, 1: 1.0}, names, 9, 0.005)
    got, model = replicas.collect(), toxicity._averaged(replicas, start, names)
    assert len({r["shard"] for r in got}) == 9 and sum(r["n"] for r in got if r["block"] == toxicity.BLOCKS) == rows.count()
    step = toxicity.BUCKETS // toxicity.BLOCKS
    for k in range(toxicity.BLOCKS):
        some = [(np.frombuffer(r["data"], np.float32).reshape(step, -1), np.frombuffer(r["met"], bool)) for r in got if r["block"] == k]
        for b in range(0, step, 7):
            own = [e[b] for e, met in some if met[b]]
            want = np.mean(own, axis=0) if own else start.embedding[k * step + b]
            assert np.allclose(model.embedding[k * step + b], want, atol=1e-6)
    counts = np.ones((toxicity.BUCKETS, 2))
    for r in rows.collect():
        for p in toxicity.pieces(toxicity.split(r["text"])) if r["lang"] is not None else []:
            counts[p[0], int(r["lang"] != "en")] += 1
    assert np.allclose(model.word_log, np.log(counts / counts.sum(axis=0)), atol=1e-5)
    toxicity._calibrate(rows.select("doc_id", "text", "lang"), labels, model)
    p, y = model.raw([r["text"] for r in rows.collect()])[0], np.array([r["toxic"] for r in rows.collect()])
    f1 = [2 * (p[y == 1] >= c).sum() / max((p >= c).sum() + (y == 1).sum(), 1) for c in toxicity.CUTS]
    assert f1[toxicity.CUTS.index(model.threshold)] == max(f1)


def test_quality(spark, larger, edges, nothing):
    docs, marks = larger
    right = {}
    for rounds in (0, 2):  # alone, and after the views have taught each other over the whole pool
        model = quality.train(docs, marks, residue(F.col("doc_id"), 5) != 0, per_class=400, rounds=rounds)
        held = quality.score_quality(docs, model).join(marks, "doc_id").filter(residue(F.col("doc_id"), 5) == 0)
        hit = (F.col("score") >= 0.5).cast("int") == F.col("quality")
        right[rounds] = held.agg(F.avg(hit.cast("int"))).first()[0]
    assert right[0] > 0.96 and right[2] > 0.96 and right[2] > right[0] - 0.01
    assert len(model.taught) == 2 and model.taught[0][1] > 1000  # content teaches metadata from thousands of pages
    got = quality.score_quality(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(nothing, model).count() == 0
    assert quality.train(docs, marks.filter("quality = 1"), F.lit(True)) is None
    assert quality.train(nothing, marks, F.lit(True)) is None
    assert {r["score"] for r in quality.score_quality(edges, None).collect()} == {0.5}


def quality_words(text):
    """Hash and buckets of each word, byte by byte."""
    words = [w for w in (text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    out = []
    for w in words:
        h = 0
        for k, c in enumerate(w):
            h = (h + ((c + 32 if 65 <= c <= 90 else c) + 1) * pow(quality.FACTOR, k, 1 << 64)) & mask
        h = mix(h)
        tail = sum(c * 256**k for k, c in enumerate(w[::-1][:3]))
        some = lambda test: int(any(map(test, w))) + int(all(map(test, w)))
        upper, digit = (lambda c: 65 <= c <= 90), (lambda c: 48 <= c <= 57)
        other = lambda c: c < 128 and not chr(c).isalnum()
        shape = min(15, len(w))
        for part, width in ((some(upper), 3), (some(digit), 3), (some(other), 3), (w[0] if other(w[0]) else 0, 256), (w[-1] if other(w[-1]) else 0, 256), (int(len(w) > 1 and w[-2] == w[-1]), 2)):
            shape = shape * width + part
        out.append((h, [mix(x + (salt << 32) & mask) % m for x, salt, m in zip((h, tail, shape), (0, 1, 2), quality.CONTENT)]))
    return [[*buckets, int(k > 0 and out[k - 1][0] == h)] for k, (h, buckets) in enumerate(out)]


def quality_brute(model, text, source, lang, size):
    words, spans = quality_words(text), quality._spans(quality.CONTENT)
    x = sum(model.content[s.start + f] for found in words for s, f in zip(spans, found))
    x /= max(1, len(words))
    y = sum(model.metadata[s.start + f] for s, f in zip(quality._spans(quality.METADATA), quality.page_features(source, lang, size)))
    (a, b), (c, d) = model.scales
    return 1 / (1 + np.exp(-np.clip(model.mix[0] * (a * x + b) + model.mix[1] * (c * y + d) + model.mix[2], -30, 30)))


def test_quality_features_do_not_depend_on_the_block(monkeypatch, edge_rows):
    import pyarrow as pa

    texts = pa.array([r[1] for r in edge_rows])
    whole = quality.Pages.content(texts)
    assert whole[0].tolist() == [f for r in edge_rows for f in quality_words(r[1])] and whole[2].tolist() == [len(quality_words(r[1])) for r in edge_rows]
    monkeypatch.setattr(quality, "BLOCK", 50)
    for found in (quality.Pages.content(texts), quality.Pages.content(pa.concat_arrays([texts, texts]).slice(len(texts)))):
        assert all((a == b).all() for a, b in zip(whole, found))
    assert len(quality.Pages.content(pa.array([], pa.string()))[0]) == 0


def test_quality_query_by_brute_force(spark, sf_dir, documents, labels):
    from palimpsest.llm.queries import queries

    model = quality.train(documents, labels, residue(F.col("doc_id"), 5) != 0)
    rows = {r["doc_id"]: r for r in documents.collect()}
    got = queries()["op4_quality"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        d = rows[r["doc_id"]]
        want = quality_brute(model, d["text"], d["source"], d["lang"], d["n_chars"])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_sums_by_brute_force(spark, edges, edge_rows):
    rows = edges.select("text", "source", "lang", F.col("n_chars").alias("size"), (F.coalesce("doc_id", F.lit(0)) % 2).cast("int").alias("label"))
    sums, taught = quality._sums(rows.repartition(3))
    content, metadata, n = np.zeros((2, sum(quality.CONTENT))), np.zeros((2, sum(quality.METADATA))), [0, 0]
    for r in rows.collect():
        c, words = r["label"], quality_words(r["text"])
        n[c] += 1
        for found in words:
            for s, f in zip(quality._spans(quality.CONTENT), found):
                content[c, s.start + f] += 1 / len(words)
        for s, f in zip(quality._spans(quality.METADATA), quality.page_features(r["source"], r["lang"], r["size"])):
            metadata[c, s.start + f] += 1
    assert np.allclose(sums[0], content, atol=0.02) and (sums[1] == metadata).all() and (taught == n).all()
    again, _ = quality._sums(rows.repartition(7, "text"))
    assert all((a == b).all() for a, b in zip(sums, again))


def test_quality_views_teach_each_other(spark):
    rnd = np.random.default_rng(3)
    good, bad = [f"good{k}" for k in range(300)], [f"bad{k}" for k in range(300)]
    rows = []
    for k in range(1500):
        c = k % 2
        words = rnd.choice(good if c else bad, 12).tolist() + ["and"] * 3
        rows.append((k, " ".join(words), f"{'site' if c else 'spam'}{rnd.integers(4)}", "en", 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality.train(docs, marks, F.lit(True))
    assert all(a > 500 and b > 500 for a, b in model.taught)  # both views taught most of the pool
    got = quality.score_quality(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got]) > 0.99
    rare = [model.content[quality_words(w)[0][0]] for w in good]
    assert np.mean(np.array(rare) > 0) > 0.95  # also words that no labelled page has


def toxicity_brute(model, text):
    """The network on one text, window by window, filter by filter."""
    words = toxicity.split(text)
    e = [model.embedding[p].astype(float).sum(axis=0) for p in toxicity.pieces(words)] + [np.zeros(toxicity.WIDTH)] * (toxicity.PAD + 1)
    z = model.out_bias
    at = 0
    for w, n in toxicity.FILTERS.items():
        for f in range(n):
            best = max(sum(float(e[p + j] @ model.kernels[w][j][:, f]) for j in range(w) if p + j < len(e)) for p in range(len(words) + 1))
            z += max(0.0, best + float(model.biases[w][f])) * float(model.out[at])
            at += 1
    p, cut = 1 / (1 + np.exp(-np.clip(z, -30, 30))), model.threshold
    if model.languages:
        logs = [sum(float(model.word_log[b[0], k]) for b in toxicity.pieces(words)) for k in range(len(model.languages))]
        cut = model.thresholds[int(np.argmax(logs))]
    return 0.5 * p / cut if p < cut else 0.5 + 0.5 * (p - cut) / (1 - cut)


def test_toxicity_query_by_brute_force(spark, sf_dir, documents, labels, edge_rows):
    from palimpsest.llm.queries import queries

    model = toxicity.train(documents, labels, residue(F.col("doc_id"), 5) != 0)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = queries()["op2_toxicity"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    short = [r for r in got if len(texts[r["doc_id"]] or "") < 3000]
    assert len(short) > 100
    for r in short:
        assert abs(r["score"] - toxicity_brute(model, texts[r["doc_id"]])) < 1e-3, r["doc_id"]
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    for _, t, *_ in edge_rows:
        if len(t or "") < 3000:
            assert abs(model.scores([t])[0] - toxicity_brute(model, t)) < 1e-3


def language_brute(model, text):
    padded = f" {(text or '').lower()} "
    total = np.zeros(len(model.languages))
    for p in range(len(padded)):
        code = 0
        for order in language.ORDERS:
            # the n-gram that ends at p, or the longest one there is before it
            start = max(0, p - order + 1)
            code = 0
            for k, c in enumerate(padded[start : p + 1]):
                code = (code * 0x01000193 + ord(c) + k + 1) % (1 << 32)
            total += model.weights[(code * 0x9E3779B1) % (1 << 32) >> (32 - model.bits)]
    z = (total / (len(language.ORDERS) * len(padded)) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_language_query_by_brute_force(spark, sf_dir, documents, edge_rows):
    from palimpsest.llm.queries import queries

    model = language.train(documents, residue(F.col("doc_id"), 3) != 1)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = queries()["op3_language_id"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(map(str.isalpha, t)):
            assert r["lang_pred"] == "und"
        elif len(t) < 2500:
            name, score = language_brute(model, t)
            assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-4


def test_models_do_not_depend_on_partitions(spark, documents, labels):
    one, two = documents.repartition(2, "lang"), documents.repartition(7, "doc_id")
    a, b = (language.train(d, residue(F.col("doc_id"), 3) != 1) for d in (one, two))
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all() and a.temperature == b.temperature
    a, b = (toxicity.train(d, labels, residue(F.col("doc_id"), 5) != 0) for d in (one, two))
    assert (a.embedding == b.embedding).all() and a.thresholds == b.thresholds
    a, b = (quality.train(d, labels, residue(F.col("doc_id"), 5) != 0) for d in (one, two))
    assert (a.content == b.content).all() and (a.metadata == b.metadata).all() and np.allclose(a.mix, b.mix)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from palimpsest.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, sf_dir), name)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "packing":
            assert {r["doc_id"] for r in new.collect()} == set(before)
            break
        assert new.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in new.collect()}
        assert after.items() <= before.items()
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert set(after) == set(last.values())
        docs = new
    assert corpus_pipeline.run(spark, sf_dir).columns == new.columns


def test_pipeline_takes_odd_tables(spark, sf_dir, edges, nothing):
    import corpus_pipeline

    for frame in (edges, nothing):
        docs = frame.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_pipeline_by_brute_force(spark, sf_dir):
    """run() against the same five stages in plain Python, over the same trained models."""
    import struct

    import corpus_pipeline
    from test_dedup import groups_brute, print_brute

    from palimpsest.llm.common import table
    from palimpsest.llm.tokens import load, vocabulary

    frame = table(spark, sf_dir, "documents")
    docs = {r["doc_id"]: r["text"] for r in frame.collect()}
    only = lambda kept: frame.join(spark.createDataFrame([(i,) for i in kept], "doc_id long"), "doc_id").select(*frame.columns)
    model = language.train(frame, residue(F.col("doc_id"), 3) != 1)
    said = {i: language_brute(model, t) if any(map(str.isalpha, t or "")) else ("und", 1.0) for i, t in docs.items()}
    kept = {i for i, (name, score) in said.items() if name != "und" and score >= 0.5}
    model = toxicity.train(only(kept), table(spark, sf_dir, "labels"), residue(F.col("doc_id"), 5) != 0)
    kept = {i for i in kept if toxicity_brute(model, docs[i]) < 0.5}
    last = {}
    for i in kept:
        last[docs[i] or ""] = max(i, last.get(docs[i] or "", i))
    kept = set(last.values())
    kept = {i for i, (_, component) in groups_brute({i: print_brute(docs[i]) for i in kept}).items() if i == component}
    tok = load(vocabulary("word_bpe_49k.json"))
    want = {i: tok.encode(docs[i] or "", add_special_tokens=False).ids + [1] for i in kept}
    found, sequences = {i: [] for i in kept}, {}
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) and p["doc_tokens"] == len(want[p["doc_id"]])
        found[p["doc_id"]].append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own, size in [(found[i], len(x)) for i, x in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at <= 2048
