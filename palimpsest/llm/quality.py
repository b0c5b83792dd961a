"""Quality classification by co-training of two views.

One naive Bayes classifier sees a page's content: hashed words, word endings, word
shapes and repetitions of the whole text, all taken from its bytes without a loop.  The other sees only its metadata: source,
language and stated size.  Both start from a bounded labelled sample.  In every round
each classifier, calibrated on sample rows kept out of its sums, labels all documents
of the pool it is sure of, and the other one learns from these; sums of feature counts
are all that leaves a task, so the pool is the whole table at any size.  What a view
teaches weighs as much as it has proved worth on the rows kept out.  At last the
calibrated log-odds of both views are combined, and all documents are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, capped_share, discard, held, keep_share, sliced, written

#: Buckets of each kind of content feature: words, endings, shapes, repetition.
CONTENT = (1 << 15, 1 << 12, 1 << 11, 2)
#: Buckets of each kind of metadata feature: source, language, both, size.
METADATA = (1 << 16, 1 << 10, 1 << 16, 64)
#: Calibrated probability from which a view is sure of a page.
SURE = 0.95
#: What one page counts in the sums of a kind of feature, shared by its words.
PAGE = 1 << 24
#: Bytes of text worked on at a time, up to the end of a word.
BLOCK = 1 << 20
#: An odd factor and its inverse modulo 2**64, for hashes of words as sums over bytes.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
BLANK = (9, 10, 11, 12, 13, 32)


def page_features(source: str | None, lang: str | None, size: int | None) -> tuple[int, int, int, int]:
    """Buckets of a page's source, language, both, and the binary size of its length."""
    code = lambda s, salt: zlib.crc32(s.encode("utf-8", "surrogatepass"), salt)
    a, b = "" if source is None else "s" + source, "" if lang is None else "l" + lang
    known = 0 if size is None or size < 0 else 1 + min(62, int(size).bit_length())
    return code(a, 3) % METADATA[0], code(b, 4) % METADATA[1], code(f"{a}\0{b}", 5) % METADATA[2], known


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_features(data, edges):
    """Buckets of all words of texts in UTF-8: (hashes, [words, 3] buckets, words per text).

    ``data`` holds the bytes of all texts in a row, ``edges`` where they begin and the
    end.  A word is a run of bytes other than ASCII white space.  Its buckets are those
    of its bytes with A-Z lower-cased, of its last three bytes, and of its shape: its
    length, whether capitals, digits or other signs are some or all of it, and what
    signs it begins and ends with.
    """
    import numpy as np

    n = len(data)
    blank = np.isin(data, np.array(BLANK, dtype=np.uint8))
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    inside = ~blank
    open_ = inside.copy()
    open_[1:] &= blank[:-1] | edge[1:n]
    shut = inside.copy()
    shut[:-1] &= blank[1:] | edge[1:n]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(shut) + 1
    per_text = np.diff(np.searchsorted(starts, edges))
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    code = np.where(upper, data + 32, data).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(FACTOR, n), dtype=np.uint64)])
    hashes = _mixed((sums[ends] - sums[starts]) * _powers(INVERSE, n)[starts])
    size = ends - starts
    byte = lambda at, ok: np.where(ok, data[np.where(ok, at, 0)], 0).astype(np.uint64) if n else np.zeros(0, np.uint64)
    first, last = byte(starts, size > 0), byte(ends - 1, size > 0)
    tail = last + np.uint64(256) * byte(ends - 2, size > 1) + np.uint64(65536) * byte(ends - 3, size > 2)

    def some(mask):
        """0: no byte of a word, 1: some, 2: all."""
        count = np.concatenate([[0], np.cumsum(mask)])
        found = count[ends] - count[starts]
        return ((found > 0).astype(np.uint64) + (found == size)).astype(np.uint64)

    sign = lambda b: np.where((b < 48) | ((b > 57) & (b < 65)) | ((b > 90) & (b < 97)) | ((b > 122) & (b < 128)), b, 0).astype(np.uint64)
    shape = np.minimum(size, 15).astype(np.uint64)
    for part, width in ((some(upper), 3), (some(digit), 3), (some(~letter & ~digit), 3), (sign(first), 256), (sign(last), 256), ((byte(ends - 2, size > 1) == last).astype(np.uint64), 2)):
        shape = shape * np.uint64(width) + part
    buckets = [_mixed(x + np.uint64(salt << 32)) % np.uint64(m) for x, salt, m in zip((hashes, tail, shape), (0, 1, 2), CONTENT, strict=False)]
    return hashes, np.stack(buckets, axis=1).astype(np.int64), per_text


def _mixed(x):
    """A mix of the bits of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Pages:
    """Features of slices of pages."""

    @staticmethod
    def content(texts):
        """Of an Arrow string column: per word of all texts in a row its four buckets,
        and where each text's words begin and how many it has."""
        import numpy as np
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        hashes, buckets, counts = [], [], np.zeros(len(texts), np.int64)
        at, blank = 0, np.array(BLANK, dtype=np.uint8)
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and not np.isin(data[end], blank):  # on to the end of a word
                ahead = np.flatnonzero(np.isin(data[end : end + BLOCK], blank))
                end = end + int(ahead[0]) if len(ahead) else min(end + BLOCK, len(data))
            lo, hi = int(np.searchsorted(edges, at, "right")) - 1, int(np.searchsorted(edges, end, "left"))
            own = np.clip(edges[lo : hi + 1], at, end) - at
            h, b, n = word_features(data[at:end], own)
            counts[lo:hi] += n
            hashes.append(h)
            buckets.append(b)
            at = end
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        rows = np.concatenate(buckets) if buckets else np.zeros((0, 3), np.int64)
        starts = np.cumsum(counts) - counts
        again = np.zeros(len(h), dtype=np.int64)
        again[1:] = h[1:] == h[:-1]
        again[starts[counts > 0]] = 0
        return np.concatenate([rows, again[:, None]], axis=1), starts, counts

    @staticmethod
    def metadata(sources, langs, sizes):
        import numpy as np

        return np.array(list(map(page_features, sources.to_pylist(), langs.to_pylist(), sizes.to_pylist())), dtype=np.int64).reshape(-1, len(METADATA))


def _spans(kinds: tuple[int, ...]) -> list[slice]:
    out, at = [], 0
    for n in kinds:
        out.append(slice(at, at + n))
        at += n
    return out


def log_odds(good, bad, kinds: tuple[int, ...]):
    """Naive Bayes weights from feature sums of good and bad pages, kind by kind.

    Sums count pages (a page's words share one count), so the smoothing is a part
    of one page for every bucket.
    """
    import numpy as np

    out = np.zeros(len(good))
    for span, n in zip(_spans(kinds), kinds, strict=True):
        a, b = good[span] + 0.5 / n, bad[span] + 0.5 / n
        out[span] = np.log(a / a.sum()) - np.log(b / b.sum())
    return out


def fit_logistic(x, y, weight, l2: float = 1e-3, steps: int = 30):
    """Weighted logistic regression by Newton steps; the last weight is the bias."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2 * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class QualityModel:
    """Weights of both views, their calibration (slope, bias), and the combination."""

    content: object
    metadata: object
    scales: tuple = ((1.0, 0.0), (1.0, 0.0))
    mix: tuple = (0.5, 0.5, 0.0)
    worth: tuple = (1.0, 1.0)
    rounds: int = 0
    taught: tuple = ()  # pages each view labelled for the other, by round

    def raw(self, pages: Pages, texts, sources, langs, sizes):
        """Uncalibrated log-odds of each page under both views, and its features."""
        import numpy as np

        own, starts, counts = pages.content(texts)
        offsets = np.array([s.start for s in _spans(CONTENT)])
        per_word = self.content[own + offsets].sum(axis=1)
        total = np.where(counts > 0, np.add.reduceat(np.append(per_word, 0.0), starts), 0.0) if len(starts) else np.zeros(0)
        mean = total / np.maximum(counts, 1)
        meta = pages.metadata(sources, langs, sizes)
        about = self.metadata[meta + np.array([s.start for s in _spans(METADATA)])].sum(axis=1)
        return mean, about, (own, starts, counts), meta

    def calibrated(self, content, metadata):
        (a, b), (c, d) = self.scales
        return a * content + b, c * metadata + d

    def scores(self, pages: Pages, texts, sources, langs, sizes):
        """Score of each whole page in [0, 1]; 1 is good."""
        import numpy as np

        x, y = self.calibrated(*self.raw(pages, texts, sources, langs, sizes)[:2])
        a, b, c = self.mix
        return 1 / (1 + np.exp(-np.clip(a * x + b * y + c, -30, 30)))


def _columns(part, at: int = 0):
    return [part.column(k) for k in range(at, at + 4)]


def _sums(rows: DataFrame, model: QualityModel | None = None, sure: float = SURE):
    """Feature sums over ``rows`` (text, source, lang, size): [view][class, bucket].

    Without a model every row counts under its column ``label``, in both views.  With
    one, the rows one view is sure of count, under its label, in the other view.
    Counts are whole numbers, so the sums do not depend on how the rows are dealt;
    at most one row a bucket reaches the driver.
    """
    import numpy as np

    widths = (sum(CONTENT), sum(METADATA))
    line = float(np.log(sure / (1 - sure)))

    def run(batches):
        import pyarrow as pa

        held()
        pages = Pages()
        sums = [np.zeros((2, w)) for w in widths]
        taught = np.zeros((2, 2), dtype=np.int64)
        blank = QualityModel(np.zeros(widths[0]), np.zeros(widths[1]))
        for part in sliced(batches, 2048, text=0):
            x, y, (own, _, counts), meta = (model or blank).raw(pages, *_columns(part))
            if model is None:
                marks = np.array(part.column(4).to_pylist())
                picks = [(marks == c, marks == c) for c in (0, 1)]
            else:
                x, y = model.calibrated(x, y)
                picks = [(y <= -line, x <= -line), (y >= line, x >= line)]  # one view's picks count in the other
            for c, (for_content, for_metadata) in enumerate(picks):
                taught[:, c] += for_content.sum(), for_metadata.sum()
                share = np.repeat(np.where(for_content, np.rint(PAGE / np.maximum(counts, 1)), 0.0), counts)
                for k, span in enumerate(_spans(CONTENT)):
                    sums[0][c, span] += np.bincount(own[:, k], weights=share, minlength=CONTENT[k])
                for k, span in enumerate(_spans(METADATA)):
                    sums[1][c, span] += PAGE * np.bincount(meta[for_metadata, k], minlength=METADATA[k])
        for view in (0, 1):
            for c in (0, 1):
                hit = np.flatnonzero(sums[view][c])
                where = [pa.array(np.full(len(hit) + 1, v, np.int32)) for v in (view, c)]
                found = [pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(sums[view][c][hit], taught[view, c]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(where + found, names=["view", "class", "bucket", "n"])

    found = rows.mapInArrow(run, "view int, class int, bucket int, n long").groupBy("view", "class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums, taught = [np.zeros((2, w)) for w in widths], np.zeros((2, 2))
    for view, c, bucket, n in zip(*(found.column(k).to_pylist() for k in range(4)), strict=True):
        if bucket < 0:
            taught[view, c] = n
        else:
            sums[view][c, bucket] = n / PAGE
    return sums, taught


def _raw_scores(rows: DataFrame, model: QualityModel):
    """Label, weight and both views' log-odds of the sample's rows, in a fixed order."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        pages = Pages()
        for part in sliced(batches, 2048, text=0):
            x, y, _, _ = model.raw(pages, *_columns(part))
            yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), part.column(6), pa.array(x), pa.array(y)], names=["label", "weight", "place", "x", "y"])

    found = rows.mapInArrow(run, "label int, weight double, place long, x double, y double").toArrow()
    order = np.lexsort([found.column(k).to_numpy() for k in (4, 3, 2)])
    label, weight, _, x, y = (c.to_numpy()[order] for c in found.columns)
    return label.astype(float), weight, x, y


def _calibrate(rows: DataFrame, model: QualityModel) -> None:
    """Fit both views' scales and their combination on sample rows outside the sums.

    A view's worth is the share of the labels' uncertainty that its scores remove.
    """
    import numpy as np

    label, weight, x, y = _raw_scores(rows, model)
    model.scales = tuple(tuple(map(float, fit_logistic(v[:, None], label, weight))) for v in (x, y))
    def loss(z):
        return float((weight * (np.logaddexp(0, z) - label * z)).sum())

    known = float((weight * label).sum() / weight.sum())
    prior = loss(np.full(len(label), np.log(known / (1 - known))))
    model.worth = tuple(max(0.0, 1.0 - loss(z) / prior) for z in model.calibrated(x, y))
    model.mix = tuple(map(float, fit_logistic(np.stack(model.calibrated(x, y), axis=1), label, weight)))


def _pages(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    named = {"doc_id": id_col, "text": text_col, "source": source_col, "lang": lang_col}
    return docs.select(*(F.col(c).alias(k) for k, c in named.items()), F.col(size_col).cast("long").alias("size"))


VIEWS = ["text", "source", "lang", "size"]


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2000, class_bytes: int = 16 << 20, rounds: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
) -> QualityModel | None:
    """Co-train on a labelled sample and all ``usable`` rows; None if a class has no rows.

    The sample holds at most about ``per_class`` rows and ``class_bytes`` bytes of
    text a class, thinned by a hash of the id; three quarters of it give the first
    sums, the rest the calibration.  Labels other than 0 and 1 and labels without a
    document are ignored; of contradicting labels the lower one counts.  A document
    that repeats an id takes part once per row.  Null text, source, language or size
    are values like any other; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    pages = _pages(docs.filter(usable), id_col, text_col, source_col, lang_col, size_col)
    ids = pages.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    met = ids.join(marks, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    if len(met) < 2:
        return None
    share = capped_share({r["label"]: r["n"] for r in met}, per_class, {r["label"]: r["bytes"] for r in met}, class_bytes)
    # thinned before texts are touched: about 2 * per_class labels to broadcast
    chosen = marks.filter(keep_share(share, F.col("label"), F.col("doc_id"))).join(ids.select("doc_id"), "doc_id", "left_semi")
    weigh = F.when(F.col("label") == 1, F.lit(1 / share[1])).otherwise(F.lit(1 / share[0]))
    place = F.xxhash64("doc_id", F.lit("place"))
    sample = written(pages.join(F.broadcast(chosen), "doc_id").select(*VIEWS, "label", weigh.alias("weight"), place.alias("place")), "quality-sample")
    aside = F.pmod("place", F.lit(4)) == 0
    have = {(r["label"], r["aside"]) for r in sample.groupBy("label", aside.alias("aside")).count().collect()}
    if len({label for label, _ in have}) < 2:
        return None
    if len(have) == 4:
        fit, kept_out = sample.filter(~aside), sample.filter(aside)
    else:  # too few rows to keep some aside
        fit = kept_out = sample
    first, _ = _sums(fit.select(*VIEWS, "label"))
    kinds, taught = (CONTENT, METADATA), []
    model = QualityModel(*(log_odds(s[1], s[0], k) for s, k in zip(first, kinds, strict=True)))
    _calibrate(kept_out, model)
    for _ in range(rounds):
        more, pages_taught = _sums(pages.select(*VIEWS), model)
        views = []
        for view, kind in enumerate(kinds):
            own = []
            for c in (0, 1):
                a, b, n = first[view][c], more[view][c], pages_taught[view, c]
                # whatever the table's size, a class taught weighs as the labelled one, times the teacher's worth
                labelled = a[_spans(kind)[0]].sum()
                own.append(a + b * (model.worth[1 - view] * labelled / n) if n >= 1 else a)
            views.append(log_odds(own[1], own[0], kind))
        taught.append(tuple(int(x) for x in pages_taught.sum(axis=1)))
        model = QualityModel(*views)
        _calibrate(kept_out, model)
    model.rounds, model.taught = rounds, tuple(taught)
    discard(sample)
    return model


def score_quality(
    docs: DataFrame, model: QualityModel | None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
) -> DataFrame:
    """``doc_id, score`` (1: good) for every row, from its whole text and metadata.

    A null text counts as empty; null source, language and size are values of their
    own; without a model every score is 0.5.  Null ids and repeated rows keep one
    result row each, very long texts are read whole, an empty table gives an empty
    result, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held()
        pages = Pages()
        for part in sliced(batches, 2048, text=1):
            found = model.scores(pages, *_columns(part, 1)) if model else [0.5] * part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    pages = _pages(docs, id_col, text_col, source_col, lang_col, size_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return pages.mapInArrow(run, "doc_id long, score double")
