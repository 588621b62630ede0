"""The star as stored tables: build, write, find and read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import clean
from ..operators.canonical import curate
from ..operators.dims import DIM_BUILDERS
from ..operators.fact import build_fact
from ..schema import DIM_ATTRIBUTES, FACT, FACT_KEYS, FACT_LAYOUT, key_of
from ..workspace import materialise

# --- fixed values: fact columns that are read as numbers, whatever they were stored as ---
NUMERIC_FACT_COLUMNS = (
    "DepDelayMinutes", "ArrDelayMinutes", "AirTime", "Distance",
    "CRSElapsedTime", "ActualElapsedTime", "Cancelled", "Diverted",
    "DepDel15", "ArrDel15", "Dep15", "Arr15",
    "DepartureDelayGroups", "ArrivalDelayGroups",
)
INTEGER_DIM_COLUMNS = (
    "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek", "hhmm", "Hora", "Minuto",
)


@dataclass(frozen=True)
class Star:
    """Fact and dimensions; nothing is read before a query needs it."""

    fact: DataFrame
    dims: Mapping[str, DataFrame]


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a table stored as ``name/name.parquet``, ``name/`` or ``name.parquet``."""
    base = root.rstrip("/")
    candidates = [f"{base}/{name}/{name}.parquet", f"{base}/{name}", f"{base}/{name}.parquet"]
    for path in candidates:
        try:
            df = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return df.select(*columns) if columns else df
    raise FileNotFoundError(f"table {name!r} not found, tried {', '.join(candidates)}")


def _as_number(df: DataFrame, name: str):
    """Text -> double, NaN -> null; a numeric type is kept."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return F.col(name)
    return clean.number(F.col(name), dtype)


def conform(df: DataFrame, keys: Sequence[str], numbers: Sequence[str] = (), integers: Sequence[str] = ()) -> DataFrame:
    """Types a star table must have, for tables that another tool has written."""
    columns = []
    for name in df.columns:
        if name in keys:
            c = clean.whole(F.col(name), df.schema[name].dataType)
        elif name in integers:
            c = clean.whole(F.col(name), df.schema[name].dataType, "int")
        elif name in numbers:
            c = _as_number(df, name)
        else:
            c = F.col(name)
        columns.append(c.alias(name))
    return df.select(*columns)


def read_first_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A dimension with one row per key: the first one by file name and row."""
    key = key_of(name)
    placed = read_table(spark, root, name).select(
        "*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))
    dim = conform(placed, (key,), integers=INTEGER_DIM_COLUMNS)
    attributes = F.struct(*[c for c in dim.columns if c not in (key, "_place")])
    return dim.groupBy(key).agg(F.min_by(attributes, "_place").alias("_row")).select(key, "_row.*")


def load_star(spark: SparkSession, root: str, fact_name: str = FACT) -> Star:
    """Lazy scans of nine star tables that any tool may have written below ``root``."""
    fact = conform(
        read_table(spark, root, fact_name), ("fact_id", *FACT_KEYS), NUMERIC_FACT_COLUMNS, FACT_LAYOUT
    )
    return Star(fact, {name: read_first_rows(spark, root, name) for name in DIM_ATTRIBUTES})


def _write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table and scan it with the schema it is known to have."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dims(curated: DataFrame, root: str) -> dict[str, DataFrame]:
    """Build and write the dimensions side by side.

    Each scans only its own columns of the curated rows. The jobs are
    independent and end in small steps, so while one finishes its tail the
    others keep the cluster busy.
    """

    def build(name: str) -> tuple[str, DataFrame]:
        return name, _write(DIM_BUILDERS[name](curated), f"{root}/{name}")

    with ThreadPoolExecutor(max_workers=len(DIM_BUILDERS)) as pool:
        return dict(pool.map(build, DIM_BUILDERS))


def write_fact(fact: DataFrame, root: str) -> DataFrame:
    """Fact partitioned by Year and Month; ``rebalance`` keeps files few and splits a hot month."""
    return _write(fact.hint("rebalance", *FACT_LAYOUT), f"{root}/{FACT}", FACT_LAYOUT)


def build_star(landing: DataFrame, root: str) -> Star:
    """Landing table -> the nine written star tables, whose keys are unique by construction.

    The typed rows are written once, so nothing is parsed again for a dimension or the fact.
    """
    return star_of_curated(materialise(curate(landing), "typed"), root)


def star_of_curated(curated: DataFrame, root: str) -> Star:
    """The star of curated rows that are already stored; rows without a calendar date included."""
    dims = write_dims(curated, root)
    return Star(write_fact(build_fact(curated, dims), root), dims)
