"""Language of whole texts by a string kernel.

The kernel of two texts is the number of byte n-grams (n of 1 to 4) that both
have, over the root of the product of their numbers: a blended-spectrum kernel
on presence, so repeating a passage changes nothing. N-grams are hashed to
``DIMENSIONS`` columns. A bounded sample of labelled texts gives the training
rows; ``LANDMARKS`` of them, or one for each language if these are more, are the
Nystrom landmarks, whose kernel columns stand for the whole kernel matrix. One kernel ridge regression for each
language, all solved at once, weighs the landmarks. Texts are scored in batches:
presence rows times the landmarks' presence rows times the weights.

Training rows are at most ``SAMPLE`` per language, those whose texts hash
lowest, and all of a language with fewer distinct texts; only their presence
bits come to the driver, 2 KB each whatever the length of the text. A text that
occurs more than once counts once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no labelled row is there to learn from; with one language,
every other text gets it with score 1; repeated rows are scored alike; columns
named lang_pred or lang_score are replaced; a text of any length is scored whole,
in memory of a few times its size; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .text import chunks

LONGEST = 4
DIMENSIONS = 1 << 14
LANDMARKS = 256
#: Bound of the training rows of a language, and on the languages; more are refused.
SAMPLE, MOST_LANGUAGES = 1000, 500
RIDGE = 1e-3
UNDETERMINED = "und"
_ROWS_AT_ONCE = 128

#: Lower-case letters and every byte beyond ASCII stay, all others become a space.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, DIMENSIONS) of 0 and 1: which n-grams each text has."""
    rows = np.zeros((len(at) - 1, DIMENSIONS), np.float32)
    flat = rows.reshape(-1)
    data = _LETTERS[data].astype(np.uint32)
    owner = np.repeat(np.arange(len(at) - 1) * DIMENSIONS, np.diff(at))
    code = np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        code = code[:len(data) - n + 1] * np.uint32(257) + data[n - 1:]
        same = owner[:len(code)] == owner[n - 1:]
        column = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 14)).astype(np.int64)
        flat[(owner[:len(code)] + column)[same]] = 1
    return rows


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def _sample(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(presence rows, languages) of at most SAMPLE texts of each language, in a fixed order."""
    hashed = labelled.where("text IS NOT NULL AND text <> '' AND lang IS NOT NULL").select(
        "lang", "text", F.xxhash64("text").alias("h"))
    # Distinct texts, so copies do not lower the cut.
    counted = hashed.groupBy("lang").agg(F.count_distinct("h").alias("n"))
    found = counted.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = labelled.sparkSession.createDataFrame(found, counted.schema)
    # A hash below this cut leaves some 1.5 times the sample, so no task ranks a whole language; fewer than the sample
    # would be 13 standard deviations off.
    few = hashed.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.lit(1.5 * SAMPLE * (1 << 30)) / F.col("n"))
    ranked = few.dropDuplicates(["lang", "h"]).withColumn(
        "r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")))
    chosen = ranked.where(F.col("r") <= SAMPLE).select("lang", "r", "text")

    def bits(batches):
        for batch in batches:
            text = pc.utf8_lower(batch.column(2))
            packed = [np.packbits(presence(d, a) > 0, axis=1) for _, d, a in chunks(text, 1 << 18)]
            out = [row.tobytes() for part in packed for row in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "r", "bits"])

    rows = chosen.mapInArrow(bits, "lang string, r int, bits binary").orderBy("r", "lang").collect()
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows]).reshape(len(rows), DIMENSIONS // 8)
    return packed, np.array([r["lang"] for r in rows], object)


class LanguageModel:
    """``languages``, the landmarks' weights on n-grams (``columns``) and the sharpness of the scores."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, sharpness: float) -> None:
        self.languages, self.sharpness = languages, sharpness
        self.columns = (landmarks.T @ weights).astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Softmax of the one-versus-rest values of presence rows."""
        return _softmax(self.sharpness * (_normal(rows) @ self.columns))


def _softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(axis=1, keepdims=True))
    return values / values.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame) -> LanguageModel | None:
    """Learn from (text, lang); None if there is nothing to learn from."""
    packed, names = _sample(labelled)
    if not len(packed):
        return None
    languages = sorted(set(names))
    truth = np.array([languages.index(n) for n in names])
    signs = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # The sample is ordered by rank and language, so its head has all languages alike, and each of them at least once.
    landmarks = _normal(np.unpackbits(packed[:max(LANDMARKS, len(languages))], axis=1).astype(np.float32))
    gram = (landmarks @ landmarks.T).astype(np.float64)
    parts = [
        _normal(np.unpackbits(packed[i:i + 512], axis=1).astype(np.float32)) @ landmarks.T for i in range(0, len(packed), 512)
    ]
    kernel = np.concatenate(parts).astype(np.float64)
    weigh = 1 / np.bincount(truth)[truth] * len(truth) / len(languages)  # every language weighs the same
    left = kernel.T @ (weigh[:, None] * kernel) + RIDGE * len(kernel) * gram + 1e-8 * np.eye(len(gram))
    weights = np.linalg.solve(left, kernel.T @ (weigh[:, None] * signs))
    values = kernel @ weights
    grid = [0.5 * 2**i for i in range(7)]
    loss = [-np.log(_softmax(s * values)[np.arange(len(truth)), truth] + 1e-12).mean() for s in grid]
    return LanguageModel(languages, landmarks, weights, grid[int(np.argmin(loss))])


def predict(documents: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``documents`` with columns lang_pred and lang_score; those that it had under these names are replaced."""
    documents = documents.drop("lang_pred", "lang_score")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(0)
            text = pc.utf8_lower(column)
            best = np.zeros(len(column), np.int64)
            sure = np.zeros(len(column))
            if model is not None:
                first = 0
                while first < len(column):
                    rows = text.slice(first, _ROWS_AT_ONCE)
                    for i, data, at in chunks(rows):
                        values = model.scores(presence(data, at))
                        here = slice(first + i, first + i + len(values))
                        best[here], sure[here] = values.argmax(axis=1), values.max(axis=1)
                    first += len(rows)
            known = np.array([model is not None and has_letter(t.as_py()) for t in column], bool)
            names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    others = [c for c in documents.columns if c != text_col]
    kinds = documents.select(text_col, *others).schema
    kinds = kinds.add("lang_pred", "string").add("lang_score", "double")
    return documents.select(text_col, *others).mapInArrow(score, kinds).select(*documents.columns, "lang_pred", "lang_score")
