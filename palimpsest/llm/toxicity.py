"""Toxicity: a small convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
beginnings and ending, so that inflected forms of a word share evidence.
Filters of several widths run over the words, each filter's maximum over the whole
text is kept, and a logistic layer turns these maxima into a probability.  The
decision threshold is calibrated for each language; the language is guessed from
the text's words, and the reported score maps the threshold to 0.5.

A bounded sample gives the first weights only.  Then every labelled row of four fifths
is learned from, in shards whose replicas are averaged, and every labelled row of the
last fifth counts for the thresholds.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, capped_share, held, keep_share, sliced

WORD = re.compile(r"\w+")
BUCKETS, WIDTH = 1 << 15, 16
#: Filter width -> number of filters.
FILTERS = {1: 12, 2: 8, 3: 8}
PIECES = 6
PAD = max(FILTERS) - 1
BATCH = 32
#: Labelled rows and bytes of text that one replica learns from.
SHARD_ROWS, SHARD_BYTES = 1 << 14, 32 << 20
#: A replica's embeddings travel in blocks; its other parameters are one block more.
BLOCKS = 16
#: Thresholds tried, and how many toxic rows a language needs for its own.
CUTS = [k / 100 for k in range(2, 99)]
OWN_TOXIC = 10


def pieces(words: list[str]):
    """Hash buckets of each word's pieces: the word, four beginnings, an ending."""
    import numpy as np

    crc = zlib.crc32
    out = []
    for w in words:
        b = w.encode("utf-8", "surrogatepass")
        out += (
            crc(b), crc(w[:3].encode("utf-8", "surrogatepass"), 3), crc(w[:4].encode("utf-8", "surrogatepass"), 4),
            crc(w[:5].encode("utf-8", "surrogatepass"), 5), crc(w[:6].encode("utf-8", "surrogatepass"), 6), crc(w[-4:].encode("utf-8", "surrogatepass"), 9),
        )
    return (np.array(out, dtype=np.int64).reshape(-1, PIECES) % (BUCKETS - 1)) + 1  # bucket 0 is padding


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class ToxicityModel:
    embedding: object
    kernels: dict
    biases: dict
    out: object
    out_bias: float
    languages: list[str | None] = field(default_factory=list)
    word_log: object = None  # [BUCKETS, languages] log-probabilities of whole words; language None: all others
    thresholds: list[float] = field(default_factory=list)
    threshold: float = 0.5

    # -- scoring ---------------------------------------------------------------

    def _start(self):
        import numpy as np

        self._columns, at = {}, 0
        for w, n in FILTERS.items():
            for j in range(w):
                self._columns[w, j] = slice(at, at + n)
                at += n
        self._width = at
        self._memo = {}
        self._table = np.zeros((1 << 12, at + len(self.languages)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        if len(self._memo) + len(words) > 150_000:
            self._memo = {}
        first = len(self._memo) + 1  # row 0 is padding
        while first + len(words) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        for k in range(0, len(words), 4096):
            found = pieces(words[k : k + 4096])
            e = self.embedding[found].sum(axis=1)
            rows = slice(first + k, first + k + len(found))
            for (w, j), c in self._columns.items():
                self._table[rows, c] = e @ self.kernels[w][j]
            if self.languages:
                self._table[rows, self._width :] = self.word_log[found[:, 0]]
        self._memo.update((w, first + k) for k, w in enumerate(words))

    def raw(self, texts: list[str | None]):
        """Probability of each whole text, and the place of its guessed language."""
        import numpy as np

        if not hasattr(self, "_memo"):
            self._start()
        words = [split(t) for t in texts]
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self._memo))
        if len(self._memo) + len(new) > 150_000:
            new = list(dict.fromkeys(w for ws in words for w in ws))
        if new:
            self._learn(new)
        get, ids, starts = self._memo.__getitem__, [], []
        for ws in words:
            starts.append(len(ids))
            ids += map(get, ws)
            ids += [0] * (PAD + 1)
        starts = np.array(starts, dtype=np.int64)
        ids = np.array(ids, dtype=np.int64)
        # windows begin at a text's words or first blank, never in the last PAD places
        bounds = np.stack([starts, np.append(starts[1:], len(ids)) - PAD], axis=1).ravel()
        rows = self._table[ids]
        pooled = []
        for w in FILTERS:
            total = rows[:, self._columns[w, 0]].copy()
            for j in range(1, w):
                total[:-j] += rows[j:, self._columns[w, j]]
            pooled.append(np.maximum(np.maximum.reduceat(total, bounds, axis=0)[::2] + self.biases[w], 0.0))
        z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        if not self.languages:
            return p, np.zeros(len(p), dtype=np.int64)
        return p, np.add.reduceat(rows[:, self._width :].astype(np.float64), starts, axis=0).argmax(axis=1)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Score of each whole text in [0, 1]; 0.5 is its language's threshold."""
        import numpy as np

        p, at = self.raw(texts)
        cut = np.array(self.thresholds)[at] if self.languages else np.full(len(p), self.threshold)
        return np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1.0 - cut)).tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_table", "_columns", "_width")}


def _new_model(seed: int = 5) -> ToxicityModel:
    import numpy as np

    draw = np.random.default_rng(seed)
    e = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    e[0] = 0
    kernels = {w: draw.normal(0, (1.0 / (w * WIDTH)) ** 0.5, (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()}
    biases = {w: np.zeros(n, dtype=np.float32) for w, n in FILTERS.items()}
    return ToxicityModel(e, kernels, biases, draw.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32), 0.0)


class Vocabulary:
    """Word numbers from 1, and the hash buckets of each; number 0 is padding."""

    def __init__(self):
        import numpy as np

        self._numbers, self._size, self.bags = {}, 1, np.zeros((1 << 12, PIECES), dtype=np.int64)

    def ids(self, text: str | None):
        """Numbers of the text's words, and the padding behind them."""
        import numpy as np

        numbers, words = self._numbers, split(text)
        new = [w for w in dict.fromkeys(words) if w not in numbers]
        while self._size + len(new) > len(self.bags):
            self.bags = np.concatenate([self.bags, np.zeros_like(self.bags)])
        for k in range(0, len(new), 65536):
            some = pieces(new[k : k + 65536])
            self.bags[self._size : self._size + len(some)] = some
            numbers.update(zip(new[k : k + 65536], range(self._size, self._size + len(some)), strict=True))
            self._size += len(some)
        return np.array(list(map(numbers.__getitem__, words)) + [0] * (PAD + 1), dtype=np.int32)

    def __len__(self):
        return self._size


class Learner:
    """Adam on mini-batches, from a model's weights on; gradients by hand."""

    def __init__(self, model: ToxicityModel, rate: float):
        import numpy as np

        self.rate, self.step = rate, 0
        self.params = {"e": model.embedding.copy(), "o": model.out.copy(), "c": np.array([model.out_bias], dtype=np.float32)}
        self.params |= {("k", w): model.kernels[w].copy() for w in FILTERS} | {("b", w): model.biases[w].copy() for w in FILTERS}
        self.first = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.params.items()}

    def learn(self, bags, docs: list, y, weight) -> None:
        """One step on the word numbers ``docs``, their labels and weights."""
        import numpy as np

        params, first, second = self.params, self.first, self.second
        ids = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words, ids = np.unique(ids, return_inverse=True)
        bag = bags[words]
        e = params["e"][bag].sum(axis=1)
        # each word under each column of a filter once, then word by word of the texts
        under = {(w, j): (e @ params["k", w][j])[ids] for w in FILTERS for j in range(w)}
        grads = {k: np.zeros_like(v) for k, v in params.items()}
        pooled, where = [], []
        for w in FILTERS:
            total = under[w, 0]
            for j in range(1, w):
                total[:-j] += under[w, j][j:]
            best = np.stack([total[s : s + n - PAD].argmax(axis=0) + s for s, n in zip(starts, sizes, strict=True)])
            top = np.take_along_axis(total, best, axis=0) + params["b", w]
            pooled.append(np.maximum(top, 0))
            where.append((w, best, top > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ params["o"] + params["c"][0]
        d = (weight * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) / len(docs)).astype(np.float32)
        grads["o"], grads["c"] = h.T @ d, np.array([d.sum()], dtype=np.float32)
        col = 0
        for w, best, live in where:
            n = FILTERS[w]
            g = d[:, None] * params["o"][col : col + n] * live
            grads["b", w] = g.sum(axis=0)
            col += n
            for j in range(w):
                at_j = np.minimum(best + j, len(ids) - 1)
                grads["k", w][j] = np.einsum("bfd,bf->df", e[ids[at_j]], g)
                de = g[:, :, None] * params["k", w][j].T[None]
                np.add.at(grads["e"], bag[ids[at_j]].reshape(-1, PIECES), np.repeat(de.reshape(-1, 1, WIDTH), PIECES, axis=1))
        grads["e"][0] = 0
        self.step += 1
        for k, g in grads.items():
            first[k] *= 0.9
            first[k] += 0.1 * g
            second[k] *= 0.999
            second[k] += 0.001 * g * g
            params[k] -= self.rate * (first[k] / (1 - 0.9**self.step)) / (np.sqrt(second[k] / (1 - 0.999**self.step)) + 1e-8)

    def others(self):
        """All parameters but the embeddings, as one vector."""
        import numpy as np

        return np.concatenate([v.ravel() for k, v in self.params.items() if k != "e"])

    def model(self, others=None) -> ToxicityModel:
        """The model as learned, or with :meth:`others` replaced."""
        import numpy as np

        params, at = dict(self.params), 0
        if others is not None:
            for k, v in self.params.items():
                if k != "e":
                    params[k] = np.asarray(others[at : at + v.size], dtype=np.float32).reshape(v.shape)
                    at += v.size
        params["e"][0] = 0
        kernels, biases = {w: params["k", w] for w in FILTERS}, {w: params["b", w] for w in FILTERS}
        return ToxicityModel(params["e"], kernels, biases, params["o"], float(params["c"][0]))


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = BATCH, rate: float = 0.01, seed: int = 5) -> ToxicityModel:
    """Train the network on texts in memory."""
    import numpy as np

    learner, draw, vocabulary = Learner(_new_model(seed), rate), np.random.default_rng(seed), Vocabulary()
    docs = [vocabulary.ids(t) for t in texts]
    y = np.array(labels, dtype=np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            learner.learn(vocabulary.bags, [docs[k] for k in some], y[some], np.float32(1))
    return learner.model()


def _replicas(rows: DataFrame, model: ToxicityModel, weights: dict, languages: list[str | None], shards: int, rate: float) -> DataFrame:
    """``block, shard, n, data, met``: one replica's weights for each shard of ``rows``.

    A replica starts from ``model`` and takes its shard's rows once, in the order of a
    hash of their id.  Blocks below ``BLOCKS`` are embeddings, with a mark at those that
    learned; the next one holds all other parameters; then come the counts of whole
    words for each language.
    """
    place = {x: k for k, x in enumerate(languages)}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held()
        step, state = BUCKETS // BLOCKS, None

        def learn():
            if waiting:
                state["learner"].learn(state["words"].bags, [d for d, _ in waiting], *(np.array(v, dtype=np.float32) for v in zip(*[(y, weights[y]) for _, y in waiting])))
                waiting.clear()
                if len(state["words"]) > 150_000:
                    state["words"] = Vocabulary()

        def done():
            learn()
            learner = state["learner"]
            touched = learner.second["e"].any(axis=1)
            out = [(k, learner.params["e"][k * step : (k + 1) * step].tobytes(), touched[k * step : (k + 1) * step].tobytes()) for k in range(BLOCKS)]
            out.append((BLOCKS, learner.others().tobytes(), None))
            out += [(BLOCKS + 1 + k, c.tobytes(), None) for k, c in enumerate(state["counts"])]
            blocks, data, met = zip(*out)
            n = len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([state["shard"]] * n, pa.int32()), pa.array([state["n"]] * n, pa.int64()), pa.array(data, pa.binary()), pa.array(met, pa.binary())],
                names=["block", "shard", "n", "data", "met"],
            )

        waiting, size = [], 0
        for part in sliced(batches, 256, text=1):
            for shard, text, lang, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if state is None or shard != state["shard"]:
                    if state is not None:
                        yield done()
                    state = {"shard": shard, "learner": Learner(model, rate), "words": Vocabulary(), "n": 0, "counts": np.zeros((len(languages), BUCKETS), dtype=np.int64)}
                    size = 0
                ids = state["words"].ids(text)
                if lang is not None:
                    state["counts"][place.get(lang, place[None])] += np.bincount(state["words"].bags[ids[: -PAD - 1], 0], minlength=BUCKETS)
                waiting.append((ids, y))
                state["n"] += 1
                size += len(ids)
                if len(waiting) == BATCH or size > 1 << 18:
                    learn()
                    size = 0
        if state is not None:
            yield done()

    own = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")).withColumn("turn", F.xxhash64("doc_id", F.lit("turn")))
    dealt = own.repartitionById(shards, "shard").sortWithinPartitions("shard", "turn", "doc_id", "text", "lang")
    return dealt.select("shard", "text", "lang", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "block int, shard int, n long, data binary, met binary")


def _averaged(replicas: DataFrame, model: ToxicityModel, languages: list[str | None]) -> ToxicityModel:
    """The mean of all replicas, added up in order of their shards.

    An embedding is the mean of the replicas in which it learned, so that rare words
    keep what few shards taught; the other parameters weigh by rows.
    """
    import numpy as np

    embedding, step = model.embedding, BUCKETS // BLOCKS

    def run(batches):
        import pyarrow as pa

        held()
        block = total = count = None

        def done():
            if block < BLOCKS:
                old = embedding[block * step : (block + 1) * step]
                new = np.where(count > 0, total / np.maximum(count, 1), old).astype(np.float32)
            else:
                new = (total / count).astype(np.float32) if block == BLOCKS else total
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([new.tobytes()], pa.binary())], names=["block", "data"])

        for part in sliced(batches, 16):
            for k, n, data, met in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total, count = k, 0, 0
                if k < BLOCKS:
                    n = np.frombuffer(met, dtype=bool)[:, None].astype(np.float64)
                    total = total + n * np.frombuffer(data, dtype=np.float32).reshape(step, WIDTH)
                elif k == BLOCKS:
                    total = total + n * np.frombuffer(data, dtype=np.float32).astype(np.float64)
                else:
                    total = total + np.frombuffer(data, dtype=np.int64)
                count = count + n
        if block is not None:
            yield done()

    dealt = replicas.repartition(BLOCKS + 1 + len(languages), "block").sortWithinPartitions("block", "shard")
    found = {r["block"]: r["data"] for r in dealt.select("block", "n", "data", "met").mapInArrow(run, "block int, data binary").collect()}
    if not found:
        return model
    learner = Learner(model, 0.0)
    learner.params["e"] = np.concatenate([np.frombuffer(found[k], dtype=np.float32) for k in range(BLOCKS)]).reshape(BUCKETS, WIDTH).copy()
    new = learner.model(np.frombuffer(found[BLOCKS], dtype=np.float32))
    counts = [np.frombuffer(found[BLOCKS + 1 + k], dtype=np.int64) for k in range(len(languages))]
    kept = [k for k, c in enumerate(counts) if c.any()]
    if kept:
        new.languages = [languages[k] for k in kept]
        share = 1.0 + np.stack([counts[k] for k in kept], axis=1)
        new.word_log = np.log(share / share.sum(axis=0)).astype(np.float32)
    return new


def _threshold(clean, toxic) -> float:
    """Middle of the score range with the best F1, from the number of rows of each
    class between one of ``CUTS`` and the next."""
    import numpy as np

    if not toxic.sum() or not clean.sum():
        return 0.5
    # rows at or above each cut
    tp, fp = (np.cumsum(c[::-1])[::-1][1:] for c in (toxic, clean))
    f1 = 2 * tp / np.maximum(tp + fp + toxic.sum(), 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return CUTS[best[len(best) // 2]]


def _calibrate(rows: DataFrame, marks: DataFrame, model: ToxicityModel) -> None:
    """Thresholds from all labelled ``rows``: they are scored where they lie, and only
    ids and places among ``CUTS`` move."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=1):
            p, at = model.raw(part.column(1).to_pylist())
            places = np.searchsorted(CUTS, p, side="right")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.int32()), pa.array(places, pa.int32())], names=["doc_id", "guess", "place"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, guess int, place int")
    found = np.zeros((max(1, len(model.languages)), 2, len(CUTS) + 1), dtype=np.int64)
    for r in placed.join(marks, "doc_id").groupBy("guess", "toxic", "place").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["guess"], int(r["toxic"]), r["place"]] = r["n"]
    model.threshold = _threshold(*found.sum(axis=0))
    model.thresholds = [_threshold(*own) if own[1].sum() >= OWN_TOXIC else model.threshold for own in found[: len(model.languages)]]


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2500, class_bytes: int = 24 << 20,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rate: float = 0.005,
) -> ToxicityModel | None:
    """Fit on all labelled ``usable`` rows.

    First weights come from a sample of at most about ``per_class`` rows and
    ``class_bytes`` bytes of text of each class, thinned by a hash of the id.  Then all
    rows of four fifths, by a hash of the id, are learned from at ``rate``; a row weighs
    as much as its class in the sample.  All rows of the last fifth count for the
    thresholds; a guessed language with fewer than ten toxic rows there has the common
    threshold.  Languages by the rows' own column that have fewer are guessed as one.

    Labels other than 0 and 1 and labels without a document are ignored; of
    contradicting labels the higher one counts.  Null texts count as empty, rows that
    repeat an id take part once each, other columns are ignored.  Where four fifths lack
    a class, all rows are learned from and the threshold is 0.5.  Returns None if a
    class has no rows, as in an empty table.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(usable).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 0
    sizes = rows.select("doc_id", "lang", apart.alias("apart"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    met = sizes.join(marks, "doc_id").groupBy("toxic", "apart", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    large = F.when((F.col("toxic") == 1) & F.col("apart") & (F.col("n") >= OWN_TOXIC), F.col("lang"))
    met = met.groupBy("toxic", "apart").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.collect_set(large).alias("langs")).collect()
    if len({r["toxic"] for r in met}) < 2:
        return None
    if len({r["toxic"] for r in met if not r["apart"]}) < 2:
        apart = F.lit(False)
    total = lambda what: {c: sum(r[what] for r in met if r["toxic"] == c) for c in {r["toxic"] for r in met}}
    share = capped_share(total("n"), per_class, total("bytes"), class_bytes)
    # thin the labels before texts are touched: about 2 * per_class rows to broadcast
    chosen = marks.filter(keep_share(share, F.col("toxic"), F.col("doc_id")) & ~apart).join(rows.select("doc_id"), "doc_id", "left_semi")
    found = rows.drop("lang").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").toArrow()
    texts, y = found.column("text").to_pylist(), [int(v) for v in found.column("toxic").to_pylist()]
    del found
    model = fit(texts, y)
    del texts
    bounded_batches(docs.sparkSession)
    languages = sorted({x for r in met for x in r["langs"]}) + [None]
    weights = {int(c): s / max(share.values()) for c, s in share.items()}
    shards = max(1, -(-sum(total("n").values()) // SHARD_ROWS), -(-sum(total("bytes").values()) // SHARD_BYTES))
    # one plan at any size: texts move by id once, labelled ones to their shard
    labelled = rows.filter(~apart).hint("merge").join(marks, "doc_id")
    model = _averaged(_replicas(labelled, model, weights, languages, shards, rate), model, languages)
    _calibrate(rows.filter(apart), marks, model)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from its whole text alone.

    Null text counts as empty; without a model every score is 0.  Null ids and
    repeated rows keep one result row each; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=1):
            found = model.scores(part.column(1).to_pylist()) if model else [0.0] * part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without rows scored 0.5 or more; all columns stay as they are.

    The decision is made where the row lies, from its whole text: null ids and
    repeated rows stay or go by their own text, an empty table stays empty, and
    without a model every row stays.
    """
    bounded_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=text_at):
            found = model.scores(part.column(text_at).to_pylist()) if model else [0.0] * part.num_rows
            yield part.filter(pa.array([s < 0.5 for s in found]))

    return docs.mapInArrow(run, docs.schema)
