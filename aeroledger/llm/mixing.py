"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are laid end to end in a hashed order, and the words
of that stream are cut into blocks of ``block_words``. A source gives each epoch
a quota of words, which is a number of blocks (of ``block_words`` or, in a very
large corpus, as many more as keep their number below ``MOST_BLOCKS``) drawn without replacement in a
permuted order; the last one drawn is cut where the quota ends, so quotas are
met to the word. A binary tree over the output shards splits the blocks of all
sources and epochs: each node draws how many of each go to its left half from
the multivariate hypergeometric distribution, so every shard is a fair draw and
all together use each block once. A shard takes a range of the permuted order
and shuffles what it got by a hash.

Only word totals per source and the tree's counts come to the driver (at most
``MOST_SOURCES`` sources; more are refused). Prefix sums run over some sqrt(n)
hashed buckets of sqrt(n) documents for a source of n documents, so no task
holds a source.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, the last one; repeated rows are documents of their own;
an empty table gives an empty mix. The same rows give the same mix.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import materialise

MOST_SOURCES = 100_000
#: Blocks have BLOCK_WORDS words, or more where there would be more than MOST_BLOCKS of them.
BLOCK_WORDS, MOST_BLOCKS = 4096, 900_000_000
SHARDS = 64
#: A plan of at most so many numbers, 8 bytes each, is broadcast; a larger one is a written table that Spark measures.
MOST_SENT = 1 << 20
_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII space; every word shrinks to one letter, then letters count."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("bigint")


def fill_targets(sizes: Sequence[int], weights: Sequence[int], total: Fraction, most: int = 2) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off is shared again."""
    targets, left, weight = [Fraction(0)] * len(sizes), total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i])):
        targets[i] = min(Fraction(most * sizes[i]), left * weights[i] / weight)
        left -= targets[i]
        weight -= weights[i]
    return targets


def split_blocks(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(kind, shard) block counts: each node of a binary tree draws its left half's share of every kind."""
    out = np.zeros((len(counts), shards), np.int64)

    def node(held: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = held
            return
        middle = (first + last) // 2
        draw = int(held.sum()) * (middle - first) // (last - first)
        random = np.random.default_rng((seed, first, last))
        left = random.multivariate_hypergeometric(held, draw, method="marginals") if held.sum() else held
        node(left, first, middle)
        node(held - left, middle, last)

    node(counts.astype(np.int64), 0, shards)
    return out


def _permutation(n: int, key: str) -> tuple[int, int]:
    """(a, b): j -> (a * j + b) mod n is a permutation."""
    if n <= 1:
        return 1, 0
    a = int(n * 0.6180339887) + zlib.crc32(key.encode()) % max(1, n // 5)
    while math.gcd(a := max(1, a % n), n) != 1:
        a += 1
    return a, zlib.crc32(("+" + key).encode()) % n


def block_size(sizes: Sequence[int], most: int, least: int = BLOCK_WORDS) -> int:
    """Words of a block: ``least``, or as many as leave at most MOST_BLOCKS blocks in ``most`` epochs of all sources."""
    return max(least, -(-most * sum(sizes) // (MOST_BLOCKS - most * len(sizes))))


def _plan(stats: list, weights: Sequence[int], share: Fraction, most: int, shards: int, block_words: int, seed: int):
    """Rows of the plan table: one per source, with an entry for each epoch."""
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in stats]
    cycle = [weights[i % len(weights)] for i in range(len(stats))]
    targets = fill_targets(sizes, cycle, share * sum(sizes), most) if stats else []
    epochs, counts = [], []
    for i, (size, target) in enumerate(zip(sizes, targets)):
        left, n, of_source = round(target), -(-size // block_words), []
        for epoch in range(most):
            quota = min(left, size)
            left -= quota
            a, b = _permutation(n, f"{seed}:{i}:{epoch}")
            cut = n * block_words - size  # by how much the last block is short
            short_at = (a * (n - 1) + b) % n if n else 0
            drawn = -(-quota // block_words)
            if drawn > short_at:
                drawn = -(-(quota + cut) // block_words)
            of_source.append({"epoch": epoch, "quota": quota, "a": a, "b": b, "n": n, "cut": cut, "short_at": short_at})
            counts.append(min(drawn, n))
        epochs.append(of_source)
    cuts = np.cumsum(split_blocks(np.array(counts, np.int64), shards, seed), axis=1)
    rows = []
    for i, r in enumerate(stats):
        for e, entry in enumerate(epochs[i]):
            entry["ends"] = cuts[i * most + e].tolist()
        rows.append((r["source"], r["source"] is None, i, max(1, math.ceil(math.sqrt(r["n"]))), sizes[i], float(targets[i]), epochs[i]))
    return rows


_PLAN = (
    "source string, unnamed boolean, source_no int, buckets int, source_size bigint, target double, epochs array<struct<"
    "epoch:int, quota:bigint, a:bigint, b:bigint, n:bigint, cut:bigint, short_at:bigint, ends:array<bigint>>>"
)


def _pieces(block_words: int, seed: int) -> Column:
    """Array of (shard, order, epoch, word_from, word_to): what the mix takes of one document."""
    w = block_words

    def piece(e: Column, j: Column) -> Column:
        rank = (e["a"] * j + e["b"]) % e["n"]
        before = rank * w - F.when(rank > e["short_at"], e["cut"]).otherwise(F.lit(0))
        taken = F.greatest(F.lit(0), e["quota"] - before)
        start = F.greatest(F.col("start"), j * w)
        end = F.least(F.col("start") + F.col("size"), (j + 1) * w, j * w + taken)
        return F.struct(
            F.size(F.filter(e["ends"], lambda x: x <= rank)).alias("shard"),
            F.xxhash64(F.lit(seed), F.col("source_no"), e["epoch"], j, F.col("doc_id")).alias("order"),
            e["epoch"].alias("epoch"), (start - F.col("start")).alias("word_from"), (end - F.col("start")).alias("word_to"),
        )

    blocks = F.sequence(F.floor(F.col("start") / w).cast("bigint"), F.floor((F.col("start") + F.col("size") - 1) / w).cast("bigint"))
    every = F.flatten(F.transform("epochs", lambda e: F.transform(blocks, lambda j: piece(e, j))))
    none = F.lit(None).cast("array<struct<shard:int,order:bigint,epoch:int,word_from:bigint,word_to:bigint>>")
    return F.when(F.col("size") > 0, F.filter(every, lambda p: p["word_to"] > p["word_from"])).otherwise(none)


def mix_sources(
    documents: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
    shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, pieces), a row for each row of ``documents``.

    ``pieces`` lists the slices of the document in the mix, see ``shard_rows``; ``taken`` is their words.
    """
    spark = documents.sparkSession
    sized = materialise(documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("place"),
    ), "mix-sizes")
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    block_words = block_size([r["size"] for r in stats], most, block_words)
    rows = _plan(stats, weights, Fraction(share), most, shards, block_words, seed)
    plan = spark.createDataFrame(rows, _PLAN).withColumn("source", F.coalesce("source", F.lit("")))
    plan = F.broadcast(plan) if len(rows) * most * (shards + 8) <= MOST_SENT else materialise(plan, "mix-plan")
    named = sized.withColumns({"unnamed": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    planned = named.join(
        plan.withColumnRenamed("source", "_source"), ["unnamed", "_source"]
    ).withColumn("bucket", F.pmod("place", "buckets"))
    in_bucket = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = planned.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select(
        "source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start")
    )
    placed = (
        planned.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(starts, ["source_no", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("inside"))
        .withColumn("pieces", _pieces(block_words, seed))
    )
    taken = F.aggregate(
        F.coalesce("pieces", F.array().cast("array<struct<shard:int,order:bigint,epoch:int,word_from:bigint,word_to:bigint>>")),
        F.lit(0).cast("bigint"), lambda n, p: n + p["word_to"] - p["word_from"],
    )
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


def shard_rows(mix: DataFrame) -> DataFrame:
    """(shard, order, doc_id, source, epoch, word_from, word_to): the mix itself; sort a shard by ``order`` to shuffle it."""
    return mix.select("doc_id", "source", F.explode("pieces").alias("p")).select(
        "p.shard", "p.order", "doc_id", "source", "p.epoch", "p.word_from", "p.word_to")
