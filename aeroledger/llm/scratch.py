"""Tables between rounds that are deleted as soon as the next round's stand."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..workspace import drop_table, setting, shuffles_dropped, write_table  # noqa: F401

#: Rows of whole texts that pass to and from Python at once; a batch is held twice, by the JVM and by Python.
BATCH_ROWS = 1_000


class Round:
    """Tables that are deleted together, once no DataFrame reads them any more."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table, path = write_table(df, name)
        self.tables.append((df.sparkSession, path))
        return table

    def drop(self) -> None:
        while self.tables:
            drop_table(*self.tables.pop())


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, actions hand ``BATCH_ROWS`` rows at most to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(key))
    with setting(spark, key, str(min(given, BATCH_ROWS) if given > 0 else BATCH_ROWS)):
        yield
