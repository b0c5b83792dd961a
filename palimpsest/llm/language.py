"""Language identification: sparse multinomial logistic regression.

Features are character n-grams (one to four characters of the lower-case text),
hashed, weighted by TF-IDF: relative frequency in the text times inverse document
frequency.  Document frequencies are counted over all training documents; weights
are fitted with follow-the-regularised-leader (per-coordinate, elastic net) on a
bounded, per-language sample; a temperature fitted on rows left out of the fit
calibrates the probabilities.  Scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, capped_share, held, keep_share, sliced

BITS = 15
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


def grams(texts: list[str | None], bits: int = BITS):
    """Hashed n-grams of every text: (codes of all texts in a row, their offsets).

    A text contributes its lower-case characters with a blank before and after.
    """
    import numpy as np

    padded = [f" {(t or '').lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.uint32(32 - bits)
    out = []
    rolled = np.zeros_like(chars)
    for order in ORDERS:
        # position p holds the n-gram that ends there; those reaching into the
        # text before are replaced by the shorter n-gram's value
        grown = rolled.copy()
        grown[order - 1 :] = (np.concatenate([rolled[:1], rolled[:-1]])[order - 1 :] if order > 1 else 0) * np.uint32(0x01000193) + chars[order - 1 :] + np.uint32(order)
        for p in range(order - 1):
            inside = offsets[:-1] + p < offsets[1:]
            grown[offsets[:-1][inside] + p] = rolled[offsets[:-1][inside] + p]
        rolled = grown
        out.append((rolled * np.uint32(0x9E3779B1)) >> shift)
    return out, offsets


@dataclass
class LanguageModel:
    languages: list[str]
    weights: object  # float32 [2**bits, languages], IDF included
    bias: object
    temperature: float
    bits: int = BITS

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and calibrated probability of each whole text."""
        import numpy as np

        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        codes, offsets = grams(texts, self.bits)
        total = np.zeros((len(texts), len(self.languages)))
        for order in codes:
            total += np.add.reduceat(self.weights[order], offsets[:-1], axis=0)
        z = (total / (len(ORDERS) * np.diff(offsets))[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names, scores = [], []
        for t, b, row in zip(texts, best, p, strict=True):
            letters = t is not None and any(map(str.isalpha, t))
            names.append(self.languages[b] if letters else UNKNOWN)
            scores.append(float(row[b]) if letters else 1.0)
        return names, scores


def _document_frequency(texts: DataFrame, bits: int):
    """How many texts hold each hashed n-gram, over all rows, and their number.

    Tasks send one count per n-gram bucket; the result has ``2**bits`` rows.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        seen = np.zeros(1 << bits, dtype=np.int64)
        rows = 0
        held()
        for part in sliced(batches, 256, text=0):
            codes, offsets = grams(part.column(0).to_pylist(), bits)
            rows += len(offsets) - 1
            mark = np.zeros(1 << bits, dtype=bool)
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                mark[:] = False
                for order in codes:
                    mark[order[i:j]] = True
                seen += mark
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(seen[hit], rows))], names=["bucket", "n"]
        )

    counted = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, rows = np.zeros(1 << bits), 0
    for bucket, n in zip(counted["bucket"], counted["n"], strict=True):
        if bucket < 0:
            rows = int(n)
        else:
            df[bucket] = n
    return df, rows


def _sample_features(rows: DataFrame, bits: int):
    """Hashed n-gram counts of sampled rows: list of (label, buckets, frequencies),
    in an order that does not depend on how the rows are dealt."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=1):
            codes, offsets = grams(part.column(1).to_pylist(), bits)
            buckets, shares = [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found, n = np.unique(np.concatenate([c[i:j] for c in codes]), return_counts=True)
                buckets.append(found.astype(np.int32))
                shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["label", "place", "buckets", "shares"],
            )

    place = F.xxhash64("doc_id", "text").alias("place")
    found = rows.select("lang", "text", place).mapInArrow(run, "label string, place long, buckets array<int>, shares array<float>").toArrow()
    order = np.lexsort([found.column("label").to_numpy(), found.column("place").to_numpy()]).tolist()
    columns = [found.column(name) for name in ("label", "buckets", "shares")]
    return [(a[k].as_py(), b[k].values.to_numpy(), c[k].values.to_numpy()) for a, b, c in [columns] for k in order]


def fit_ftrl(rows, classes: int, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3):
    """Multinomial logistic regression by FTRL-proximal with an elastic net.

    ``rows`` are (class, indices, values); the last column is the bias, which is
    not penalised.  Returns dense weights, zero wherever the l1 penalty wins.
    """
    import numpy as np

    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        penal = np.where(at == size, 0.0, l1)[:, None]
        return np.where(np.abs(zi) <= penal, 0.0, -(zi - np.sign(zi) * penal) / ((beta + np.sqrt(ni)) / alpha + np.where(at == size, 0.0, l2)[:, None]))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, at, x = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def fit_temperature(logits, labels) -> float:
    """The temperature with the least negative log-likelihood (golden section).

    Labels are smoothed by one pseudo-row, so that a sample without errors does
    not make the scores certain.
    """
    import numpy as np

    smooth = 1.0 / (len(labels) + logits.shape[1])

    def loss(log_t):
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        right = (1 - smooth) * z[np.arange(len(z)), labels] + smooth * z.mean(axis=1)
        return float((np.log(np.exp(z).sum(axis=1)) - right).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(
    docs: DataFrame, usable: Column, per_language: int = 800, language_bytes: int = 4 << 20, bits: int = BITS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Fit on the ``usable`` rows with a text and a language.

    ``per_language`` and ``language_bytes`` bound the rows and the text of each
    language used for the weights and the temperature, thinned by a hash of the id;
    document frequencies come from all usable rows.  Rows whose text or language is
    null take no part, repeated rows count once each, other columns are ignored.
    Without usable rows the model has no languages.  The same rows give the same
    model, however they are dealt over tasks.
    """
    import numpy as np

    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    met = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    counts, sizes = {r["lang"]: r["n"] for r in met}, {r["lang"]: r["bytes"] for r in met}
    if not counts:
        return LanguageModel([], None, None, 1.0, bits)
    bounded_batches(docs.sparkSession)
    languages = sorted(counts)
    df, total = _document_frequency(rows.select("text"), bits)
    idf = np.log((1.0 + total) / (1.0 + df)) + 0.1
    chosen = rows.filter(keep_share(capped_share(counts, per_language, sizes, language_bytes), F.col("lang"), F.col("doc_id")))
    number = {name: k for k, name in enumerate(languages)}
    sample = [(number[label], at, (x * (idf[at] * 30.0)).astype(np.float32)) for label, at, x in _sample_features(chosen, bits)]
    held = [s for k, s in enumerate(sample) if k % 5 == 0] if len(sample) >= 20 else sample
    fit = [s for k, s in enumerate(sample) if k % 5] if len(sample) >= 20 else sample
    w, b = fit_ftrl(fit, len(languages), 1 << bits)
    logits = np.array([x @ w[at] + b for _, at, x in held])
    temperature = fit_temperature(logits, np.array([s[0] for s in held])) if len(held) else 1.0
    return LanguageModel(languages, (w * (idf * 30.0)[:, None]).astype(np.float32), b, temperature, bits)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    A null text, or one without letters, is ``und`` with score 1; a model without
    languages (no training rows) says ``und`` with score 0.  Null ids and repeated
    rows keep one result row each; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=1):
            names, scores = model.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that are ``und`` or whose score is below ``least``.

    All columns stay as they are, null ids and repeated rows too; the decision is
    made where the row lies, from its whole text alone.
    """
    bounded_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        held()
        for part in sliced(batches, 256, text=text_at):
            names, scores = model.predict(part.column(text_at).to_pylist())
            yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
