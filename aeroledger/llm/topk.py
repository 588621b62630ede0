"""Exact top-k search by inner product: distributed histogram selection.

Every candidate is scored against every query of a block with one matrix
product per Arrow batch. A score is never stored. Rounds of global score
histograms locate the k-th best score of each query: each round counts the
scores of the range that still holds it in ``bins`` equal parts and goes on
with one part, until the part is one score wide. A last pass keeps what scores
higher, and of the ties at the k-th score those with the smallest ids.

A task reports a histogram only from its top down to its own k-th score: what
lies below cannot hold the global k-th. So a round sends at most k counts for
each query and task, whatever the number of candidates.

Queries go out in blocks of at most ``block_bytes``; more queries mean more
passes, not a larger broadcast.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; vectors of different lengths do not
meet; an empty vector scores 0 with other empty ones; rows with the query's id
are not its candidates; a repeated candidate row takes a rank for each time, a
repeated query row is answered once; no queries or no candidates give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BINS = 1024
BLOCK_BYTES = 1 << 20
SCALE = 256.0
_EXACT = 1 << 53
_ROWS_AT_ONCE = 512


def quantised(ids: pa.Array, vectors: pa.Array, scale: float = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * vectors)) of the rows that take part, by vector length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = vectors.combine_chunks(), ids.combine_chunks()
    starts = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    lengths = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    there = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for length in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == length))
        matrix = np.floor(scale * values[starts[rows, None] + np.arange(length)])
        finite = np.isfinite(matrix).all(axis=1)
        if finite.any():
            yield numbers[rows[finite]], matrix[finite]


def _largest_norm(vectors: DataFrame, id_col: str, vector_col: str) -> int:
    """An integer at least as large as any product of two of the vectors."""

    def squares(batches):
        for batch in batches:
            most = [float((m * m).sum(axis=1).max()) for _, m in quantised(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_pydict({"most": pa.array([max(most, default=0.0)], pa.float64())})

    most = vectors.select(id_col, vector_col).mapInArrow(squares, "most double").agg(F.max("most")).first()[0]
    if most is not None and not math.isfinite(most):
        raise ValueError("scores do not fit a double")
    return math.ceil((most or 0.0) * (1 + 1e-9))


def _scores(block, batch: pa.RecordBatch, exact: bool):
    """(row numbers in the block, candidate ids, scores) for parts of a batch; own rows are masked out."""
    for ids, matrix in quantised(batch.column(0), batch.column(1)):
        if matrix.shape[1] not in block:
            continue
        numbers, query_ids, queries = block[matrix.shape[1]]
        for i in range(0, len(ids), _ROWS_AT_ONCE):
            part, own = matrix[i:i + _ROWS_AT_ONCE], ids[i:i + _ROWS_AT_ONCE]
            if exact:
                score = (queries @ part.T).astype(np.int64)
            else:
                whole = np.vectorize(int, otypes=[object])
                score = (whole(queries) @ whole(part).T).astype(np.int64)
            yield numbers, own, score, query_ids[:, None] != own[None, :]


def _histogram(vectors, block, low, high, width, bins, need, exact):
    """Counts of the scores in [low, high) by query and bin; each task reports its top bins up to its own k-th score."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((block, low, high, width, need))

    def count(batches):
        block, low, high, width, need = shared.value
        counts = np.zeros((len(low), bins), np.int64)
        flat = counts.reshape(-1)
        for batch in batches:
            for numbers, _, score, other in _scores(block, batch, exact):
                least, most = low[numbers][:, None], high[numbers][:, None]
                here = other & (score >= least) & (score < most)
                at = numbers[:, None] * bins + (score - least) // width[numbers][:, None]
                cells, n = np.unique(at[here], return_counts=True)
                flat[cells] += n
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, col = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_pydict(
            {"query": pa.array(row, pa.int64()), "bin": pa.array(col, pa.int64()), "n": pa.array(counts[row, col])}
        )

    found = vectors.mapInArrow(count, "query bigint, bin bigint, n bigint").groupBy("query", "bin").agg(F.sum("n"))
    rows = np.array([tuple(r) for r in found.collect()], np.int64).reshape(-1, 3)
    shared.unpersist()
    total = np.zeros((len(low), bins), np.int64)
    total[rows[:, 0], rows[:, 1]] = rows[:, 2]
    return total


def _kth_scores(vectors, block, n, k, bound, bins, exact) -> tuple[np.ndarray, np.ndarray]:
    """The k-th best score of each query (its lowest, if it has fewer) and how many places ties at it may take."""
    low, high = np.full(n, -bound, np.int64), np.full(n, bound + 1, np.int64)
    width = (high - low + bins - 1) // bins
    need = np.full(n, k, np.int64)
    while True:
        counts = _histogram(vectors, block, low, high, width, bins, need, exact)
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        enough = from_top >= need[:, None]
        at = np.where(enough.any(axis=1), bins - 1 - enough[:, ::-1].argmax(axis=1), 0)
        here = np.arange(n)
        short = ~enough.any(axis=1)  # fewer than k in all: the lowest score stays the bound, nothing more to count
        need = np.where(short, need, need - (from_top[here, at] - counts[here, at]))
        low = np.where(short, -bound, low + at * width)
        high = np.where(short, low, np.minimum(high, low + width))
        if (width == 1).all():
            return low, need
        width = np.where(short, 1, (width + bins - 1) // bins)


def _selected(vectors, block, kth, need, exact) -> DataFrame:
    """Rows that score above the k-th score, and each task's smallest ids of the ties at it."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, kth, need))

    def select(batches):
        block, kth, need = shared.value
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for numbers, own, score, other in _scores(block, batch, exact):
                row, col = np.nonzero(other & (score > kth[numbers][:, None]))
                yield _found(numbers[row], own[col], score[row, col])
                row, col = np.nonzero(other & (score == kth[numbers][:, None]))
                for r in np.unique(row):
                    q = int(numbers[r])
                    both = np.concatenate((ties.get(q, own[:0]), own[col[row == r]]))
                    ties[q] = np.sort(both)[:need[q]]
        for q, ids in ties.items():
            yield _found(np.full(len(ids), q), ids, np.full(len(ids), kth[q]))

    return vectors.mapInArrow(select, "query bigint, vec_id bigint, score bigint")


def _found(query, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "query": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64()),
    })


def exact_topk(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    bins: int = BINS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id."""
    spark = candidates.sparkSession
    columns = [F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding")]
    vectors = candidates.select(*columns)
    asked = queries.select(*columns).where("vec_id IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["vec_id", "embedding"])
    bound = max(_largest_norm(vectors, "vec_id", "embedding"), _largest_norm(asked, "vec_id", "embedding"), 1)
    if bound >= 1 << 62:
        raise ValueError("scores do not fit a bigint")
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 8), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(size / block_bytes))
    parts = []
    for b in range(n_blocks):
        of_block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        table = of_block.orderBy("vec_id").toArrow()
        block, ids, n = {}, [], 0
        for query_ids, matrix in quantised(table.column(0), table.column(1)) if table.num_rows else ():
            block[matrix.shape[1]] = (np.arange(n, n + len(query_ids)), query_ids, matrix)
            ids.append(query_ids)
            n += len(query_ids)
        if not n:
            continue
        exact = bound < _EXACT
        kth, need = _kth_scores(vectors, block, n, k, bound, bins, exact)
        names = spark.createDataFrame(list(enumerate(np.concatenate(ids).tolist())), "query bigint, query_id bigint")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = _selected(vectors, block, kth, need, exact).withColumn("rank", F.row_number().over(best))
        parts.append(ranked.where(F.col("rank") <= k).join(names, "query").select("query_id", "rank", "vec_id", "score"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)
