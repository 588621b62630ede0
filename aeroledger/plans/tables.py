"""Tables of flights and of table sizes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators.enrich import add_columns, available_columns
from ..operators.filters import filtered_fact
from ..operators.ids import first_rows
from ..schema import FACT
from ..sources.datamart import Star
from .rollup import top_n

# --- fixed values: columns of the flight table and its limits ---
FLIGHT_COLUMNS = (
    "Year", "Month", "FlightDate",
    "Airline", "Origin", "OriginCityName", "Dest", "DestCityName",
    "DepDelayMinutes", "ArrDelayMinutes", "AirTime", "Distance",
    "Cancelled", "Diverted",
    "Tail_Number", "Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline",
)
DEFAULT_ROWS, MOST_ROWS = 500, 5_000


def flight_table(star: Star, request: Any = None) -> DataFrame:
    """The first flights that pass the filters, by fact id.

    The limit is applied to the fact alone, so dimensions are joined to the few
    rows that are shown.
    """
    limit = top_n(request if isinstance(request, Mapping) else None, DEFAULT_ROWS, MOST_ROWS)
    first = first_rows(filtered_fact(star, request), "fact_id", limit)
    shown = [c for c in FLIGHT_COLUMNS if c in available_columns(star)]
    return add_columns(first, star, shown).orderBy("fact_id").select(*shown)


def star_row_counts(star: Star) -> DataFrame:
    """Rows of each star table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in {**star.dims, FACT: star.fact}.items()
    ]
    return reduce(DataFrame.unionByName, counts)
