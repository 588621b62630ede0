"""Dense ids 1..n without moving a large table into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ROW_SEQ
from ..workspace import materialise

# monotonically_increasing_id keeps the partition above this bit, the row below it.
PARTITION_BIT = 33


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def first_rows(df: DataFrame, id_col: str, n: int, bits: int = 20) -> DataFrame:
    """The n rows with the lowest ids, in order.

    A plain sort with a limit sends n rows of every task to one task. Here ids
    are counted in blocks of 2**bits first; only rows up to the block that
    holds the n-th are read again and sorted, and the bound on the id can skip
    files.
    """
    block = F.shiftright(F.col(id_col), bits)
    counts = df.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        counts.select("block", F.sum("n").over(up_to).alias("up_to"))
        .where(F.col("up_to") >= n).agg(F.min("block")).first()[0]
    )
    few = df if last is None else df.where(F.col(id_col) < (last + 1) << bits)
    return few.orderBy(id_col).limit(n)


def number_stored_rows(df: DataFrame, id_col: str, seq: str = ROW_SEQ) -> DataFrame:
    """1..n in the order of a stored ``monotonically_increasing_id``, without sorting.

    Only the rows per written partition are counted; their running total (one
    row per partition) is written and joined back. Spark broadcasts it by its
    file size.
    """
    part = F.shiftright(F.col(seq), PARTITION_BIT)
    counts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")),
        "offsets",
    )
    row_in_part = F.col(seq).bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    return (
        df.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(id_col, F.col("_before") + row_in_part + 1)
        .drop("_part", "_before")
    )


def number_sorted(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """1..n in the order of ``order`` (ascending, nulls last): sorted by ranges, then numbered by partition."""
    ranges = df.repartitionByRange(*nulls_last(order)).sortWithinPartitions(*nulls_last(order))
    stored = materialise(ranges.withColumn("_seq", F.monotonically_increasing_id()), f"{id_col}-sorted")
    return number_stored_rows(stored, id_col, "_seq").select(id_col, *df.columns)
