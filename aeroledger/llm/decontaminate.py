"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are words (runs of letters and digits of any script, lower-cased) and the
sets of their five-word shingles. A document may be thousands of times as long
as a test item, so one signature length cannot serve all: documents are
partitioned by the power of two above their number of shingles, and each
partition has its own one-permutation MinHash with ``BINS_PER_SHINGLE`` bins
for each shingle of its largest set. The signature of an item is taken once for
every partition, with that partition's bins. A document is a candidate of an
item if they agree in one bin. With this ratio a shingle that both share
survives in both signatures with probability (1 - e^-x) / x, x the reciprocal
of the ratio, 0.94 or more, so an item of which n shingles are in the document
is missed with a probability of about 0.06^n. That is too much for few shingles,
so of an item of up to ``FEW`` every shingle hash is looked up among all of the
document's, and none is missed. Candidates are verified: an item is found if at
least ``THRESHOLD`` of its distinct shingles, compared as words, occur in the
document.

Documents are read once for every block of items; a block holds items of at
most some ``BLOCK_CHARS`` characters, so what is broadcast is bounded and more
items mean more passes. Nothing is shuffled but the pairs found.

Defined cases: null and empty texts have no shingles and are found nowhere; a
text of one to four words is one shingle as a whole, so such an item is found
only in documents that are the same words; a repeated document gives its pairs
for each row, a repeated item is searched once for each distinct (id, text); an
empty table on either side gives no pairs.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import hash_runs, runs, shingle_hashes, shingle_layout

WORDS, THRESHOLD = 5, 0.8
BINS_PER_SHINGLE = 8
#: Items of up to so many shingles are looked up whole; of longer ones THRESHOLD asks for 8 or more, missed with 0.06^8.
FEW = 8
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_texts(words: list[str], k: int = WORDS) -> set[str]:
    """Distinct shingles as words between spaces."""
    if not words:
        return set()
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def _hashes(words: list[str]) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text."""
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = runs(data != 0x20, np.array([0, len(data)]))
    begin, left, _ = shingle_layout(np.zeros(len(starts), np.int64), WORDS, 1)
    return np.unique(shingle_hashes(hash_runs(data, starts, ends), begin, left))


def size_class(n: int) -> int:
    """Partition of a set of n shingles."""
    return max(0, math.ceil(math.log2(n))) if n else 0


def signature(hashes: np.ndarray, partition: int) -> np.ndarray:
    """One-permutation MinHash: of the hashes that fall in a bin the least, as numbers that also tell the bin."""
    bits = partition + int(math.log2(BINS_PER_SHINGLE))
    # Sorted hashes have their bin in the high bits, so the first of each bin is its minimum.
    bins = hashes >> np.uint64(64 - bits)
    first = np.ones(len(hashes), bool)
    first[1:] = bins[1:] != bins[:-1]
    return hashes[first]


class ItemIndex:
    """Shingle hashes of the items with few, and signature values of the others for every partition."""

    def __init__(self, items: list[tuple]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.sets = [_hashes(w) for w in self.words]
        self.few = self._sorted([s if len(s) <= FEW else s[:0] for s in self.sets])
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _sorted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all items in order, and the item of each."""
        values = np.concatenate([*parts, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def table(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted signature values of the longer items in a partition, and the item of each."""
        if partition not in self._tables:
            self._tables[partition] = self._sorted([signature(s, partition) if len(s) > FEW else s[:0] for s in self.sets])
        return self._tables[partition]

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items with few shingles that share one with a document, others that agree with its signature in a bin."""
        partition = size_class(len(hashes))
        found = [np.empty(0, np.int64)]
        for (values, owner), mine in ((self.few, hashes), (self.table(partition), signature(hashes, partition))):
            if len(values) and len(mine):
                at = np.searchsorted(mine, values)
                found.append(owner[mine[np.minimum(at, len(mine) - 1)] == values])
        return np.unique(np.concatenate(found))


def contained(item: list[str], document: list[str]) -> tuple[int, int]:
    """(distinct shingles of the item, how many of them occur in the document), by words."""
    wanted = shingle_texts(item)
    if min(len(item), len(document)) < WORDS:
        return len(wanted), len(wanted & shingle_texts(document))
    text = f" {' '.join(document)} "
    return len(wanted), sum(f" {s} " in text for s in wanted)


def find_leaks(
    documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item that a document contains."""
    spark = documents.sparkSession
    kind, item_kind = dict(documents.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    schema = f"doc_id {kind}, item_id {item_kind}, n_shingles int, n_shared int, containment double"
    asked = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text")).where("text <> ''").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(size / block_chars))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = []
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b).collect()
        if rows:
            item_type = to_arrow_type(items.schema[item_id_col].dataType)
            found.append(_search(texts, ItemIndex([tuple(r) for r in rows]), threshold, schema, item_type))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _search(texts: DataFrame, index: ItemIndex, threshold: float, schema: str, item_type: pa.DataType) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)
    names = [part.split()[0] for part in schema.split(", ")]

    def search(batches):
        index = shared.value
        for batch in batches:
            out = []
            for row, item in enumerate(batch.column(1)):
                document = words_of(item.as_py())
                for i in index.candidates(_hashes(document)) if document else ():
                    n, k = contained(index.words[i], document)
                    if k >= threshold * n - 1e-9:
                        out.append((row, index.ids[i], n, k, k / n))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), pa.array([o[1] for o in out], item_type),
                pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32()),
                pa.array([o[4] for o in out], pa.float64()),
            ], names)

    return texts.mapInArrow(search, schema)


def drop_leaks(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``documents`` without those that contain an item; rows with a null id stay unless their id is found."""
    leaks = find_leaks(documents, items, **options).select(F.col("doc_id").alias("_leak")).distinct()
    id_col = options.get("id_col", "doc_id")
    return documents.join(leaks, documents[id_col].eqNullSafe(leaks["_leak"]), "left_anti")
