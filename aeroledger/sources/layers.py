"""Landing, curated and functional layers: what is written between raw files and queries."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.ids import PARTITION_BIT, first_rows
from ..schema import FILE_PLACE, ROW_SEQ
from ..workspace import materialise, setting, shuffles_dropped

log = logging.getLogger(__name__)


def sorted_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted across partitions: one range shuffle, no global sort in one task."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _numbered_by_place(raw: DataFrame) -> DataFrame:
    """Rows of ingested files with ``ingest_seq``: the place of their block in the order of files and blocks, and their own in it.

    Rows of a block are read in order by one task, so where none are missing among their numbers only blocks are counted
    and no row is moved. Records with line breaks in quotes have gaps; tables with such files are sorted.
    """
    block = [F.col(f"{FILE_PLACE}.{c}").alias(c) for c in ("file", "block")]
    blocks = materialise(raw.groupBy(*block).agg(
        F.min(f"{FILE_PLACE}.row").alias("first"), F.max(f"{FILE_PLACE}.row").alias("last"), F.count(F.lit(1)).alias("n")), "file-blocks")
    if not blocks.where("last - first + 1 <> n").isEmpty():
        return sorted_by(raw, [FILE_PLACE]).drop(FILE_PLACE).withColumn(ROW_SEQ, F.monotonically_increasing_id())
    ranked = blocks.select(  # a row for each block
        F.struct("file", "block").alias("_block"), "first", (F.row_number().over(Window.orderBy("file", "block")) - 1).cast("bigint").alias("_rank"))
    ranked = materialise(ranked, "file-ranks").withColumnRenamed("first", "_first")
    placed = raw.withColumn("_block", F.struct(*block)).join(ranked, "_block", "left")
    rank = F.coalesce("_rank", F.raise_error(F.lit("a file was split in another way than when its blocks were counted")).cast("bigint"))
    seq = F.shiftleft(rank, PARTITION_BIT).bitwiseOR(F.col(f"{FILE_PLACE}.row") - F.col("_first"))
    return placed.withColumn(ROW_SEQ, seq).drop("_block", "_first", "_rank", FILE_PLACE)


def land(raw: DataFrame, path: str, row_key: Sequence[str] = ()) -> DataFrame:
    """Write raw rows once, with the position of every row fixed in ``ingest_seq``.

    Rows of ingested files are numbered by file and place in it, others sorted by
    the columns of ``row_key``; without either they keep the order of the scan.
    Every later rule on "first row" or "row number" reads the stored position,
    so no later step sorts the fact again.
    """
    spark = raw.sparkSession
    # Both scans of ingested files must split them alike, however many cores there are by then.
    with shuffles_dropped(spark), setting(spark, "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)):
        if FILE_PLACE in raw.columns:
            numbered = _numbered_by_place(raw)
        else:
            numbered = (sorted_by(raw, row_key) if row_key else raw).withColumn(ROW_SEQ, F.monotonically_increasing_id())
        numbered.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return read_landing(spark, path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_curated(curated: DataFrame, path: str) -> None:
    """Partition by Year and Month; rows without either are not written.

    ``rebalance`` groups the rows of a month into few files and lets AQE split
    a month that is much larger than the others.
    """
    (
        curated.dropna(subset=["Year", "Month"])
        .hint("rebalance", "Year", "Month")
        .write.mode("overwrite").partitionBy("Year", "Month").parquet(path)
    )


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """One folder per table, snappy Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{root}/{name}")


def write_orc(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").orc(path)


def try_write_orc(df: DataFrame, path: str) -> bool:
    """Write ORC where it can be written; the Parquet table stands without it."""
    try:
        write_orc(df, path)
    except (PySparkException, Py4JJavaError) as error:
        log.warning("no ORC copy at %s: %s", path, error)
        return False
    return True


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (UTF-8, no byte order mark)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_sample(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """The first rows in landing order as CSV."""
    write_csv(first_rows(df, ROW_SEQ, rows, PARTITION_BIT).drop(ROW_SEQ), path)
