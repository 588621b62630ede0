"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

A term's list holds an impact for each document that has it. All lists are cut at the same impacts into levels, from the
highest to the lowest, and written by level; a search reads one level after another and never looks up a document. For
every (item, document) met it keeps a lower bound, the score of what was read, and with it an upper bound: a list not
yet met can add at most its weight times the impact read down to. Lists of terms that few documents hold are read
whole at the first level, so only long lists stay open.

After each level the k-th highest lower bound of an item is known. Documents whose upper bound is below it go, and once
even a document met in no list so far cannot reach it, the item takes no new ones; when no item does, only what the held
documents have in a level is read. The search ends when all held documents have equal bounds; at the last impact, 0,
they have. Ties with the k-th bound are never dropped, and equal scores are ordered by id, so the result is exact.

The intervals of a document are one row, and so are its postings of a level. A level and the intervals are joined by
document, sums for all items are made inside a task, and only intervals that can still matter are written.

Impacts are integers of 64 bits and sums of them are exact; lengths that would overflow are multiplied as Python's.
Items are searched in groups whose texts are of bounded size, since their terms are sent to all tasks.

Defined cases: a null or empty text has no term, counts in no statistic and is never found; an item without terms finds
nothing; rows with equal ids are documents (or items) of their own, ranked in the order they are read; null ids come
last among equal scores; a very long text is split by words in one piece of its batch; an empty table gives no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..workspace import materialise
from .scratch import drop_table, write_table

#: Everything in ASCII that is no digit or letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Impact of an endless number of occurrences.
MOST_IMPACT = 1_000_000
#: Shares of all postings that are read at the end of each level but the last.
LEVELS = (1 / 64, 1 / 16, 1 / 4)
#: Lists of at most one document in so many are read whole at the first level.
SHORT_LIST = 64
BIN = 1000
#: Characters of item texts, or of document texts, that are handled at a time.
ITEM_CHARS, TEXT_BYTES = 4_000_000, 4 << 20
#: Sums of (document, item) that a task makes at a time.
SUMS = 1 << 20
#: Groups of tasks whose best documents are ranked apart before they are ranked together.
PARTS = 64


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts in order, row of each)."""
    if texts.offset:
        # Splitting a slice in place reads at wrong offsets.
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), SEPARATORS)
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(terms, "")
    return terms.filter(real), rows.filter(real).to_numpy()


def _pieces(batch: pa.RecordBatch, column: int):
    """The batch in slices of some ``TEXT_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values that are sorted by row, as one list a row."""
    at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _schema(df: DataFrame, columns: str) -> StructType:
    """A schema whose column ``doc`` has the type it has in ``df``."""
    return StructType.fromDDL(columns.replace("doc,", f"doc {df.schema['doc'].dataType.simpleString()},"))


def count_terms(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, place, length, terms, tfs) of documents with a term: the listed terms they hold, by number, and how often."""
    schema = _schema(documents, "doc, place bigint, length bigint, terms array<int>, tfs array<bigint>")
    arrow = to_arrow_schema(schema)
    listed = documents.sparkSession.sparkContext.broadcast(pa.array(terms, pa.large_string()))

    def count(batches):
        width = max(1, len(listed.value))
        for batch in batches:
            for piece in _pieces(batch, 2):
                words, rows = split_terms(piece.column(2))
                n = piece.num_rows
                code = pc.fill_null(pc.index_in(words, listed.value), -1).to_numpy().astype(np.int64)
                held = code >= 0
                pairs, tf = np.unique(rows[held] * width + code[held], return_counts=True)
                row, term = np.divmod(pairs, width)
                out = pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), pa.array(np.bincount(rows, minlength=n), pa.int64()),
                    _lists(term, row, n, pa.int32()), _lists(tf, row, n, pa.int64()),
                ], schema=arrow)
                yield out.filter(pc.greater(out.column(2), 0))

    return documents.select("doc", "place", "text").mapInArrow(count, schema)


def impacts(tf: np.ndarray, length: np.ndarray, row: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each posting of documents of some length."""
    norm = np.array([75 + 25 * int(n) * n_docs // n_terms for n in length], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm[row])


def _postings(counted: DataFrame, n_docs: int, n_terms: int, short: np.ndarray, cuts: np.ndarray | None):
    """Rows (level, place, terms, impacts), or without cuts rows (bin, n) for a histogram of impacts."""
    sent = counted.sparkSession.sparkContext.broadcast(short)

    def read(batch):
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        return row, lists.flatten().to_numpy(), impacts(
            batch.column(3).flatten().to_numpy(), batch.column(1).to_numpy(), row, n_docs, n_terms)

    def histogram(batches):
        total = np.zeros(MOST_IMPACT // BIN + 1, np.int64)
        for batch in batches:
            _, term, impact = read(batch)
            total += np.bincount(impact[~sent.value[term]] // BIN, minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bin", "n"])

    def levels(batches):
        for batch in batches:
            row, term, impact = read(batch)
            level = np.where(sent.value[term], 0, np.searchsorted(-cuts, -impact, "left"))
            for at in range(len(cuts) + 1):
                here = level == at
                rows, inside = np.unique(row[here], return_inverse=True)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), at), pa.int32()), batch.column(0).take(pa.array(rows)),
                        _lists(term[here], inside, len(rows), pa.int32()), _lists(impact[here], inside, len(rows), pa.int32()),
                    ], ["level", "place", "terms", "impacts"])

    held = counted.where(F.size("terms") > 0).select("place", "length", "terms", "tfs")
    if cuts is None:
        return held.mapInArrow(histogram, "bin bigint, n bigint")
    return held.mapInArrow(levels, "level int, place bigint, terms array<int>, impacts array<int>")


class Bounds:
    """What a task needs to bound scores: the items of each term with its weight in them, and the state of each item."""

    def __init__(self, counts: list[Counter], numbers: dict[str, int], weight: np.ndarray, short: np.ndarray) -> None:
        pairs = sorted((numbers[t], i, n * int(weight[numbers[t]])) for i, c in enumerate(counts) for t, n in c.items())
        pairs = np.array([p for p in pairs if p[2]], np.int64).reshape(-1, 3)
        self.at = np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(numbers)))))
        self.item, self.weight = pairs[:, 1], pairs[:, 2]
        # Weight of the lists that are not read whole at once, of each pair and in all of each item.
        self.long = np.where(short[pairs[:, 0]], 0, self.weight)
        self.open = np.zeros(len(counts), np.int64)
        np.add.at(self.open, self.item, self.long)
        self.least = np.zeros(len(counts), np.int64)
        self.n_items = len(counts)

    def sums(self, row, term, impact, held_row, held_item, held_score, held_met):
        """(row, item, score, met) after a level: what was held of some documents, and what their postings add."""
        n = self.at[term + 1] - self.at[term]
        which = np.repeat(self.at[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.concatenate([held_row * self.n_items + held_item, np.repeat(row, n) * self.n_items + self.item[which]])
        score = np.concatenate([held_score, self.weight[which] * np.repeat(impact, n)])
        met = np.concatenate([held_met, self.long[which]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        if not len(first):
            return (np.empty(0, np.int64),) * 4
        return *np.divmod(key[first], self.n_items), np.add.reduceat(score[order], first), np.add.reduceat(met[order], first)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists; null lists are empty."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), length), column.flatten().to_numpy().astype(np.int64)


def _summed(batches, bounds: Bounds):
    """(places, row, item, score, met) for slices of batches (place, terms, impacts, items, scores, mets)."""
    for batch in batches:
        row, term = _flat(batch.column(1))
        sums = np.bincount(row, bounds.at[term + 1] - bounds.at[term], batch.num_rows).astype(np.int64)
        part = np.cumsum(sums + 1) // SUMS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            row, term = _flat(piece.column(1))
            held_row, held_item = _flat(piece.column(3))
            yield piece.column(0), *bounds.sums(
                row, term, _flat(piece.column(2))[1], held_row, held_item, _flat(piece.column(4))[1], _flat(piece.column(5))[1])


_INTERVALS = "place bigint, items array<int>, scores array<bigint>, mets array<bigint>"


def _hold(rows: DataFrame, bounds: Broadcast, depth: int) -> DataFrame:
    """The intervals that can still reach the k-th lower bound when lists are read down to an impact."""

    def work(batches):
        b = bounds.value
        for places, row, item, score, met in _summed(batches, b):
            can = score + (b.open[item] - met) * depth >= b.least[item]
            rows, inside = np.unique(row[can], return_inverse=True)
            if len(rows):
                yield pa.RecordBatch.from_arrays([
                    places.take(pa.array(rows)), _lists(item[can], inside, len(rows), pa.int32()),
                    _lists(score[can], inside, len(rows), pa.int64()), _lists(met[can], inside, len(rows), pa.int64()),
                ], ["place", "items", "scores", "mets"])

    return rows.mapInArrow(work, _INTERVALS)


def _lowest(rows: DataFrame, bounds: Broadcast, k: int) -> list:
    """(item, score): the k-th highest lower bound of the items that have so many; a task sends its k best of an item."""

    def work(batches):
        items, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, _, item, score, _ in _summed(batches, bounds.value):
            items, scores = np.concatenate([items, item]), np.concatenate([scores, score])
            order = np.lexsort((-scores, items))
            items, scores = items[order], scores[order]
            begin = np.searchsorted(items, items)
            best = np.arange(len(items)) - begin < k
            items, scores = items[best], scores[best]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(scores)], ["item", "score"])

    few = rows.mapInArrow(work, "item int, score bigint")
    return _best(few, k, [F.desc("score")]).where(F.col("rank") == k).select("item", "score").collect()


def _best(scored: DataFrame, k: int, order: list) -> DataFrame:
    """The first k rows of each item; those of some tasks are ranked before all are."""
    parts = scored.withColumn("part", F.spark_partition_id() % PARTS)
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _unsettled(held: DataFrame, bounds: Broadcast) -> bool:
    """Whether an interval has unequal bounds."""

    def work(batches):
        for batch in batches:
            open_left = bounds.value.open[_flat(batch.column(1))[1]] > _flat(batch.column(3))[1]
            if open_left.any():
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["open"])

    return not held.mapInArrow(work, "open boolean").isEmpty()


def _level_cuts(counted: DataFrame, n_docs: int, n_terms: int, short: np.ndarray) -> np.ndarray:
    """Impacts at which the levels end, from the highest; the last level ends at 0."""
    bins = _postings(counted, n_docs, n_terms, short, None).groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    above = np.cumsum([b["n"] for b in bins])
    ends = [next(b["bin"] for b, up in zip(bins, above) if up >= share * above[-1]) for share in LEVELS] if bins else []
    return np.array(sorted({e * BIN for e in ends} - {0}, reverse=True), np.int64)


def _search(documents: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """(item, rank, doc, score) for a group of items (number, text)."""
    spark = documents.sparkSession
    terms, rows = split_terms(pa.array([text for _, text in items], pa.large_string()))
    counts = [Counter() for _ in items]
    for term, row in zip(terms.to_pylist(), rows):
        counts[row][term] += 1
    numbers = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    counted = materialise(count_terms(documents, list(numbers)), "term-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    short = df * SHORT_LIST <= n_docs
    bounds = Bounds(counts, numbers, weight, short)
    cuts = _level_cuts(counted, n_docs, n_terms, short)
    postings, _ = write_table(_postings(counted, n_docs, n_terms, short, cuts), "postings", by="level")
    sc, columns = spark.sparkContext, ["place", "terms", "impacts", "items", "scores", "mets"]

    held, path = write_table(spark.createDataFrame([], _INTERVALS), "intervals")
    taking = np.ones(len(items), bool)
    for at, depth in enumerate([*(int(c) for c in cuts), 0]):
        level = postings.where(F.col("level") == at)
        rows = level.join(held, "place", "full" if taking.any() else "right").select(*columns)
        if at == 0:
            for row in _lowest(rows, sc.broadcast(bounds), k):
                bounds.least[row["item"]] = row["score"]
        following, following_path = write_table(_hold(rows, sc.broadcast(bounds), depth), "intervals")
        drop_table(spark, path)
        held, path = following, following_path
        none = F.lit(None).cast("array<int>")
        alone = held.withColumns({"terms": none, "impacts": none}).select(*columns)
        for row in _lowest(alone, sc.broadcast(bounds), k):
            bounds.least[row["item"]] = row["score"]
        taking &= bounds.open * depth >= np.maximum(bounds.least, 1)
        if not taking.any() and not _unsettled(held, sc.broadcast(bounds)):
            break
    pairs = _hold(alone, sc.broadcast(bounds), 0).select("place", F.explode(F.arrays_zip("items", "scores")).alias("pair"))
    scored = pairs.select("place", F.col("pair.items").alias("item"), F.col("pair.scores").alias("score")).where("score > 0")
    # Ties with the k-th document are still there, so that ids decide between them.
    scored = scored.join(counted.select("place", "doc"), "place")
    places = F.broadcast(spark.createDataFrame([(i, number) for i, (number, _) in enumerate(items)], "item int, number bigint"))
    found = _best(scored, k, [F.desc("score"), F.col("doc").asc_nulls_last(), F.col("place")]).join(places, "item")
    return materialise(found.select("number", "rank", "doc", "score"), "found")


def ranked_search(
    documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k highest-scoring documents of every item, as far as scores are above 0."""
    spark = documents.sparkSession
    number = F.monotonically_increasing_id()
    asked = materialise(items.select(
        number.alias("number"), F.col(item_id_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")), "items")
    texts = documents.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_groups = max(1, math.ceil(size / item_chars))
    found = []
    for group in range(n_groups):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(n_groups)) == group).select("number", "text").collect()
        if rows:
            found.append(_search(texts, [tuple(r) for r in rows], k))
    if not found:
        found = [spark.createDataFrame([], _schema(texts, "number bigint, rank int, doc, score bigint"))]
    return reduce(DataFrame.unionByName, found).join(asked, "number").select(
        F.col("item").alias(item_id_col), "rank", F.col("doc").alias(id_col), "score")
