"""Raw files of a folder -> one table that has all rows of every readable file, and where each was read.

A file is taken whole or not at all. One scan per kind of file finds out which
ones can be read to their end; the rest are left out by their path and listed
in a report. The driver holds what Spark's own listing holds, an entry for each
file: its path, and for CSV its header and whether it is refused, which one job collects. A CSV file is refused, with a
reason, when a record has more fields than the header (fewer are filled with nulls), when it is not UTF-8, when a
quoted value has no end, or when it has no header. Repeated column names are numbered, lines before the header that are
empty are passed over, and a file with a header alone is read as no rows.
"""

from __future__ import annotations

import csv
import io
import logging
import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.clean import null_words_to_null
from ..schema import FILE_PLACE
from ..workspace import materialise
from .csv_records import read_lines, records

log = logging.getLogger(__name__)

# File names are matched whatever their case.
CSV_FILES = "*.[cC][sS][vV]"
PARQUET_FILES = "*.[pP][aA][rR][qQ][uU][eE][tT]"


@dataclass(frozen=True)
class Ingested:
    """``rows`` of the files that were read, and ``report``: (path, length, n_rows, skipped, reason) of all of them."""

    rows: DataFrame
    report: DataFrame


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the matching files or table folders directly in ``folder``."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True)  # folders in a table are no columns here
    try:
        return scan.load(f"{folder.rstrip('/')}/{pattern}").select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint")


def same_path(c: Column) -> Column:
    """A path in one form; listings and scans write the file scheme differently."""
    return F.regexp_replace(c, "^file:/+", "/")


def place() -> Column:
    """Sort key of a scanned row: file, block, and order within the block."""
    return F.struct(
        same_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _paths(files: DataFrame) -> list[str]:
    return sorted(r["path"] for r in files.select("path").collect())  # an entry for each file, as in Spark's listing


#: Why a file is refused as a whole.
RAGGED, NOT_UTF8, UNENDED, NO_HEADER = "a record has more fields than the header", "not UTF-8", "a quoted value has no end", "no header"


@dataclass(frozen=True)
class CsvFile:
    """Column names of a file, whether a quoted value breaks a line, and why it is refused, if it is."""

    names: tuple[str, ...]
    breaks: bool
    reason: str | None


def column_names(header: str) -> tuple[str, ...]:
    """Names of a header record; a repeated one gets a number, an empty one is named by its place."""
    names: list[str] = []
    given = next(csv.reader(io.StringIO(header.lstrip("\ufeff"))), [])
    for i, name in enumerate(n or f"Unnamed: {i}" for i, n in enumerate(given)):
        unique, again = name, 0
        while unique.lower() in (n.lower() for n in names):
            again += 1
            unique = f"{name}.{again}"
        names.append(unique)
    return tuple(names)


def csv_files(spark: SparkSession, files: list[str]) -> dict[str, CsvFile]:
    """What each file is, from one scan of all lines and, for files that break lines in quotes, of their records."""
    where = F.struct("block", "row")
    filled = F.trim(F.regexp_replace("value", r"\r$", "")) != ""
    lines = read_lines(spark, files).groupBy("path").agg(
        F.min_by(F.when(filled, F.regexp_replace("value", r"\r$", "")), F.when(filled, where)).alias("head"),
        F.max("commas_0").alias("commas"), F.bool_or("open_0").alias("breaks"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
    ).collect()  # an entry for each file
    found, broken = {}, [r["path"] for r in lines if r["breaks"] and r["utf8"]]
    for r in lines:
        names = column_names(r["head"] or "")
        ragged = RAGGED if r["commas"] >= max(1, len(names)) else None
        found[r["path"]] = CsvFile(names, r["breaks"], NOT_UTF8 if not r["utf8"] else None if r["breaks"] else ragged if names else NO_HEADER)
    if broken:
        heads = records(spark, broken).groupBy("path").agg(F.min_by("text", "number").alias("head"), F.max("fields").alias("fields"))
        found.update({path: CsvFile((), True, UNENDED) for path in broken})
        for r in heads.collect():
            names = column_names(r["head"])
            found[r["path"]] = CsvFile(names, True, RAGGED if r["fields"] > len(names) else None)
    return found


def _scanned(spark: SparkSession, names: tuple[str, ...], files: list[str]) -> DataFrame:
    """Rows of files in which every line is a record, read by Spark's own parser."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True).csv(files)
    return rows.select("*", place().alias(FILE_PLACE))


def _assembled(spark: SparkSession, names: tuple[str, ...], files: list[str]) -> DataFrame:
    """Rows of files with line breaks in quotes: their records, each parsed by Spark as it would parse a line."""
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = F.from_csv("text", schema, {"escape": '"'})
    place_of = F.struct(same_path(F.col("path")).alias("file"), F.col("block"), F.col("row"))
    rows = records(spark, files)
    heads = rows.groupBy("path").agg(F.min("number").alias("head"))
    rows = rows.join(heads, "path").where(F.col("number") > F.col("head")).select(parsed.alias("r"), place_of.alias(FILE_PLACE))
    return rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)], FILE_PLACE)


def read_csv_files(spark: SparkSession, folder: str) -> tuple[list[DataFrame], dict[str, str | None]]:
    """(an all-text table per distinct header, missing-value words as null; why each file is refused, or None)."""
    files = _paths(list_files(spark, folder, CSV_FILES))
    known = csv_files(spark, files) if files else {}
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for path, file in sorted(known.items()):
        if file.reason is None:
            groups[file.names, file.breaks].append(path)
    tables = []
    for (names, breaks), group in groups.items():
        rows = (_assembled if breaks else _scanned)(spark, names, group)
        tables.append(rows.select(*[null_words_to_null(F.col(f"`{c}`")).alias(c) for c in names], FILE_PLACE))
    return tables, {path: file.reason for path, file in known.items()}


def _parquet_schemas(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[T.StructType, list[str]]]:
    """Files or table folders by their schema; those without a readable footer are in none."""

    def schema_of(path: str) -> T.StructType | None:
        try:
            return spark.read.parquet(path).schema
        except (PySparkException, Py4JJavaError) as error:
            log.warning("no footer in %s: %s", path, type(error).__name__)
            return None

    found: dict[str, tuple[T.StructType, list[str]]] = {}
    with ThreadPoolExecutor(max_workers=16) as pool:
        for path, schema in zip(files, pool.map(schema_of, files)):
            if schema is not None and schema.fields:
                found.setdefault(schema.json(), (schema, []))[1].append(path)
    return found


def _parquet_counts(spark: SparkSession, schema: T.StructType, files: Sequence[str]) -> DataFrame:
    """(path, n_rows, n_read): rows that the footers promise, and rows that can be decoded in all columns."""
    path = same_path(F.col("_metadata.file_path")).alias("path")
    promised = spark.read.schema(T.StructType([])).parquet(*files).groupBy(path).agg(F.count(F.lit(1)).alias("n_rows"))
    scan = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*files)  # a damaged file ends early
    whole = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in schema.names])
    decoded = scan.select(path, whole.alias("h")).groupBy("path").agg(F.count(F.lit(1)).alias("n_read"), F.max("h").alias("h"))
    # The footers of files without rows were read, too, but no scan has a row of them.
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PARQUET_FILES)
    listed = binary.load(list(files)).select(same_path(F.col("path")).alias("path"))
    empty = listed.join(promised, "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("n_rows"))
    return promised.unionByName(empty).join(decoded, "path", "left").select(
        "path", "n_rows", F.when(F.col("h").isNotNull() | (F.col("n_rows") == 0), F.coalesce("n_read", F.lit(0))).alias("n_read"))


def _whole_paths(entries: Sequence[str], counts: DataFrame) -> tuple[list[str], dict[str, list[str]]]:
    """(entries whose files are all whole; the whole files of each entry that has others, too)."""
    forms = {re.sub("^file:/+", "/", entry): entry for entry in entries}
    whole, damaged = defaultdict(list), set()
    for r in counts.collect():  # an entry for each file, as in Spark's listing
        form = r["path"]
        while form and form not in forms:
            form = form.rpartition("/")[0]
        entry = forms[form]
        if r["n_read"] == r["n_rows"]:
            whole[entry].append(entry + r["path"][len(form):])
        else:
            damaged.add(entry)
    return sorted(e for e in whole if e not in damaged), {e: sorted(whole[e]) for e in sorted(damaged) if e in whole}


def read_parquet_files(spark: SparkSession, folder: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(a table per distinct schema, with the rows of whole files only; the counts of their files).

    Counts are taken once and written, so the report tells what the rows are. Only whole files are scanned for rows, and
    a read error there fails the job.
    """
    files = _paths(spark.createDataFrame([(p,) for p in _entries(spark, folder, PARQUET_FILES)], "path string"))
    tables, counts = [], []
    for schema, group in _parquet_schemas(spark, files).values():
        count = materialise(_parquet_counts(spark, schema, group), "parquet_counts")
        entries, parts = _whole_paths(group, count)
        reader = spark.read.schema(schema).option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False)
        scans = [reader.parquet(*entries)] if entries else []
        # Names of folders are columns of a table folder, also where some of its files are left out.
        scans += [reader.option("basePath", entry).parquet(*kept) for entry, kept in parts.items()]
        tables += [scan.select("*", place().alias(FILE_PLACE)) for scan in scans]
        counts.append(count)
    return tables, counts


def _entries(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files and table folders directly in a folder whose name fits; nothing is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath()) for status in found or ()]


def align_types(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Columns that two tables type differently become text, unless both are numbers."""
    types: dict[str, set[T.DataType]] = defaultdict(set)
    for df in tables:
        for field in df.schema:
            types[field.name].add(field.dataType)
    mixed = {
        name for name, kinds in types.items()
        if len(kinds) > 1 and name != FILE_PLACE and not all(isinstance(k, T.NumericType) for k in kinds)
    }
    return [
        df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns])
        for df in tables
    ]


def ingest_with_report(spark: SparkSession, folder: str) -> Ingested:
    """Every CSV and Parquet file of a folder, united by column name; absent columns are null."""
    parquet, counts = read_parquet_files(spark, folder)
    texts, refused = read_csv_files(spark, folder)
    if not texts and not parquet:
        raise FileNotFoundError(f"no readable .csv or .parquet file in {folder}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), align_types(texts + parquet))
    read = [t.groupBy(F.col(f"{FILE_PLACE}.file").alias("read_path")).agg(F.count(F.lit(1)).alias("n_rows")) for t in texts]
    read += [c.where("n_read = n_rows").select(F.col("path").alias("read_path"), "n_rows") for c in counts]
    # A file that is read but has no row is in none of the counts.
    why = spark.createDataFrame([(p, r) for p, r in refused.items()], "csv_path string, reason string").select(
        same_path(F.col("csv_path")).alias("csv_path"), "reason")
    files = list_files(spark, folder, CSV_FILES).unionByName(list_files(spark, folder, PARQUET_FILES)).select("*", same_path(F.col("path")).alias("same"))
    joined = files.join(reduce(DataFrame.unionByName, read), F.col("same") == F.col("read_path"), "left").join(
        why, F.col("same") == F.col("csv_path"), "left")
    known, in_rows = F.col("csv_path").isNotNull(), F.col("read_path").isNotNull()
    reason = F.when(known, F.col("reason")).when(~in_rows, F.when(F.col("path").rlike(r"(?i)\.csv(/|$)"), NO_HEADER).otherwise("cannot be decoded"))
    report = joined.select(
        "path", "length", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), reason.isNotNull().alias("skipped"), reason.alias("reason"))
    return Ingested(rows, report)


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``ingest_with_report``."""
    return ingest_with_report(spark, folder).rows


def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, n_rows, skipped, reason) per input file with any bytes."""
    return ingest_with_report(spark, folder).report
