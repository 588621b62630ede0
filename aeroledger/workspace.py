"""Tables written between stages, in the shared folder the cluster names.

A written table cuts lineage, survives the loss of executors, and has a file
size Spark can check before it decides to broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def use_folder(spark: SparkSession, folder: str) -> None:
    """Name the shared folder of an application whose session does not set ``spark.checkpoint.dir``."""
    _folders[spark.sparkContext.applicationId] = folder


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` or ``use_folder`` names."""
    return spark.conf.get("spark.checkpoint.dir", None) or _folders.get(spark.sparkContext.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below the shared folder."""
    folder = shared_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, or call use_folder, to a folder every executor can reach")
    return f"{folder.rstrip('/')}/aeroledger/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nothing has written to yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet table and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, name: str, by: str | None = None, rows_a_file: int = 0) -> tuple[DataFrame, str]:
    """(scan, path) of ``df`` as a fresh Parquet table, in a folder for each value of ``by``.

    A reader holds some thousand rows of a file at once, so large rows need few of them in a file.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that no DataFrame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the action that made them ends, not when the driver next collects garbage."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def clean_up(spark: SparkSession) -> None:
    """Delete every table this application has written between stages; no DataFrame may read them afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
