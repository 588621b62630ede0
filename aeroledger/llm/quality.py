"""Quality of whole texts: random-indexing word vectors, a two-layer network, calibrated probabilities.

A text's tokens are runs of letters, of digits, or of other signs; a run keeps
its case and is hashed to one of ``BUCKETS`` words. Random indexing gives every
word a sparse vector of ``DIMENSIONS`` signs, fixed by its number; a word's
vector is the sum of the sign vectors of its neighbours, two on either side,
over all documents, scaled to length 1. A document is the mean and the spread
of its words' vectors and the logarithm of its number of words. A network with
one hidden layer, trained in numpy on a bounded sample, scores it; a
temperature fitted on held-back training rows calibrates the probabilities.

Each task adds up its neighbour sums in one array of fixed size and sends a row
for every word; Spark adds them. The driver gets that table of fixed size and
the features of at most ``MOST_TRAINING`` labelled documents.

Defined cases: a null or empty text has no words and zero features, and is
scored like any other; without labels of both kinds every score is the share of
1 among them, 0.5 without any; of several labels of a document, each counts as
a row; repeated documents are scored each; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..workspace import materialise
from .text import chunks, hash_runs, mix

BUCKETS, DIMENSIONS, NEIGHBOURS, SIGNS = 8192, 32, 2, 6
MOST_TRAINING = 20_000
HIDDEN, ROUNDS, RATE = 32, 300, 0.01
N_FEATURES = 2 * DIMENSIONS + 1

#: Class of each byte: 0 for space and control, 1 for other signs, 2 for digits, 3 for letters and beyond ASCII.
_CLASS = np.ones(256, np.uint8)
_CLASS[:33] = 0
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 3


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, row) of every token, in order."""
    kind = _CLASS[data]
    n = len(kind)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[at] = True
    edges = np.flatnonzero(begins)
    word = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][word], edges[1:][word]
    row = np.searchsorted(at, starts, "right") - 1
    return (hash_runs(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), row


def sign_vectors() -> np.ndarray:
    """(BUCKETS, DIMENSIONS): the sparse vector of each word, from its number alone."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    for i in range(SIGNS):
        h = mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(SIGNS) + np.uint64(i + 1))
        out[np.arange(BUCKETS), (h >> np.uint64(1)) % np.uint64(DIMENSIONS)] = np.where(h & np.uint64(1), 1, -1)
    return out


def word_vectors(texts: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMENSIONS) of unit length from all rows of ``texts``, a table of one text column."""

    def add(batches):
        signs = sign_vectors().astype(np.int16)
        total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for _, data, at in chunks(batch.column(0), 1 << 19):
                word, row = tokens(data, at)
                near = np.zeros((len(word), DIMENSIONS), np.int16)
                for k in range(1, NEIGHBOURS + 1):
                    same = (row[k:] == row[:-k])[:, None]
                    near[k:] += signs[word[:-k]] * same
                    near[:-k] += signs[word[k:]] * same
                if len(word):
                    order = np.argsort(word, kind="stable")
                    heads = np.flatnonzero(np.diff(word[order], prepend=-1))
                    total[word[order[heads]]] += np.add.reduceat(near[order], heads, axis=0, dtype=np.int64)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(total[used, d]) for d in range(DIMENSIONS)]], ["word", *[f"d{d}" for d in range(DIMENSIONS)]]
        )

    columns = [f"d{d}" for d in range(DIMENSIONS)]
    sums = texts.mapInArrow(add, "word bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    out = np.zeros((BUCKETS, DIMENSIONS))
    for r in rows:
        out[r[0]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES): mean and spread of the word vectors of each text, and its length."""
    n = len(at) - 1
    word, row = tokens(data, at)
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, N_FEATURES), np.float32)
    here = np.flatnonzero(count)
    if len(here):
        heads = (np.cumsum(count) - count)[here]
        own, size = vectors[word], count[here, None]
        mean = np.add.reduceat(own, heads, axis=0, dtype=np.float64) / size
        square = np.add.reduceat(own * own, heads, axis=0, dtype=np.float64) / size
        out[here, :DIMENSIONS] = mean
        out[here, DIMENSIONS:-1] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -1] = np.log1p(count)
    return out


class QualityModel:
    """Two layers and a temperature."""

    def __init__(self, base: float) -> None:
        self.base, self.layers = base, None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        middle, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - middle) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> QualityModel:
    """Fit on (features, 0 or 1); every fifth row is held back for the temperature."""
    model = QualityModel(float(y.mean()) if len(y) else 0.5)
    back = np.arange(len(y)) % 5 == 0
    if len(set(y[~back])) < 2:
        return model
    random = np.random.default_rng(seed)
    middle, scale = x[~back].mean(axis=0), x[~back].std(axis=0) + 1e-3
    z, t = (x[~back] - middle) / scale, y[~back].astype(np.float64)
    weights = [
        random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(ROUNDS):
        for part in np.array_split(random.permutation(len(t)), max(1, len(t) // 256)):
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - t[part]) / len(part)
            back_hidden = error[:, None] * w2 * (1 - hidden**2)
            slopes = [z[part].T @ back_hidden + 1e-4 * w1, back_hidden.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = (middle, scale, *weights[:3], weights[3][0])
    held = model.logits(x[back])
    sign = np.where(y[back] == 1, 1.0, -1.0)
    grid = np.geomspace(0.5, 8, 33)
    loss = [np.logaddexp(0, -sign * held / g).mean() for g in grid]
    model.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
    return model


def score_quality(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """(id, score) for every document; ``labels`` (id, label) are the rows that may be learned from."""
    vectors = word_vectors(documents.select(F.col(text_col).alias("text")))
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    kind = dict(documents.dtypes)[id_col]

    def features(batches):
        for batch in batches:
            parts = [pooled(shared.value, d, a) for _, d, a in chunks(batch.column(1), 1 << 19)]
            rows = np.concatenate([*parts, np.empty((0, N_FEATURES), np.float32)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "features"])

    made = materialise(
        documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(features, f"id {kind}, features binary"),
        "quality-features",
    )
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    # Hashed with the id, so that of many copies as large a part is learned as of other rows.
    known = made.join(marked, "id").select("y", "features", F.xxhash64("id", "features", "y").alias("h"))
    n = known.count()
    few = known.where(F.pmod("h", F.lit(1 << 30)) < F.lit(1.2 * MOST_TRAINING * (1 << 30) / max(n, 1)))
    rows = few.orderBy("h", "y").limit(MOST_TRAINING).collect()
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(len(rows), N_FEATURES)
    model = train(x.astype(np.float64), np.array([r["y"] for r in rows], np.int64))
    fitted = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            x = np.array([np.frombuffer(f.as_py(), np.float32) for f in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.value.scores(x.astype(np.float64)))], ["id", "score"])

    return made.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)
