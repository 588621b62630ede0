"""The eight dimensions of the star.

Each starts with a distinct that Spark pre-aggregates per task, on only the
columns the dimension needs; what is shuffled is the size of the dimension.
Where the first row decides, the smallest landing position per distinct row is
kept, which stays a hash aggregate, and the pick happens on the small result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import hhmm_parts
from ..schema import (
    AIRCRAFT, AIRLINE, DATE, DEST, DIM_ATTRIBUTES, FLIGHT_NO, HOUR, ORIGIN, ROUTE, ROW_SEQ, key_of,
)
from .ids import number_sorted


def distinct_rows(curated: DataFrame, dim: str, required: list[str]) -> DataFrame:
    """Distinct attribute rows whose required columns are not null, ids in attribute order."""
    columns = DIM_ATTRIBUTES[dim]
    rows = curated.select(*columns).dropna(subset=required).distinct()
    return number_sorted(rows, key_of(dim), columns)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the one that comes first by ``order``.

    Meant for inputs already reduced to distinct rows with their first position.
    """
    kept = [c for c in df.columns if c != key and c not in order]
    position = F.struct(*order)
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*kept), position).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in kept])
    )


def dim_date(curated: DataFrame) -> DataFrame:
    """One row per flight date; the first row decides the other calendar columns."""
    columns = DIM_ATTRIBUTES[DATE]
    rows = curated.dropna(subset=["FlightDate"]).groupBy(*columns).agg(F.min(ROW_SEQ).alias(ROW_SEQ))
    first = first_per_key(rows, "FlightDate", [ROW_SEQ])
    return number_sorted(first.select(*columns), key_of(DATE), ["FlightDate"])


def dim_hour(curated: DataFrame) -> DataFrame:
    """One row per scheduled HHMM; departures come before arrivals."""

    def times(hhmm: str, block: str, source: int) -> DataFrame:
        return (
            curated.dropna(subset=[hhmm])
            .groupBy(F.col(hhmm).alias("hhmm"), F.col(block).alias("TimeBlock"))
            .agg(F.min(ROW_SEQ).alias(ROW_SEQ))
            .withColumn("_source", F.lit(source))
        )

    both = times("CRSDepTime", "DepTimeBlk", 0).unionByName(times("CRSArrTime", "ArrTimeBlk", 1))
    hour, minute = hhmm_parts(F.col("hhmm"))
    first = first_per_key(both, "hhmm", ["_source", ROW_SEQ])
    rows = first.select("hhmm", "TimeBlock", hour.alias("Hora"), minute.alias("Minuto"))
    return number_sorted(rows, key_of(HOUR), ["hhmm"])


def dim_airline(curated: DataFrame) -> DataFrame:
    return distinct_rows(curated, AIRLINE, ["Airline"])


def dim_origin(curated: DataFrame) -> DataFrame:
    return distinct_rows(curated, ORIGIN, ["Origin"])


def dim_dest(curated: DataFrame) -> DataFrame:
    return distinct_rows(curated, DEST, ["Dest"])


def dim_route(curated: DataFrame) -> DataFrame:
    return distinct_rows(curated, ROUTE, ["Origin", "Dest"])


def dim_aircraft(curated: DataFrame) -> DataFrame:
    return distinct_rows(curated, AIRCRAFT, ["Tail_Number"])


def dim_flight_no(curated: DataFrame) -> DataFrame:
    """Distinct flight number pairs, nulls kept, in the order they first appear."""
    pair = DIM_ATTRIBUTES[FLIGHT_NO]
    rows = curated.groupBy(*pair).agg(F.min(ROW_SEQ).alias(ROW_SEQ))
    return number_sorted(rows, key_of(FLIGHT_NO), [ROW_SEQ]).drop(ROW_SEQ)


DIM_BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    DATE: dim_date,
    HOUR: dim_hour,
    AIRLINE: dim_airline,
    ORIGIN: dim_origin,
    DEST: dim_dest,
    ROUTE: dim_route,
    AIRCRAFT: dim_aircraft,
    FLIGHT_NO: dim_flight_no,
}
