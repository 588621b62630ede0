"""Fact rows with dimension columns: only the dimensions a query needs are joined."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import AIRCRAFT, AIRLINE, DATE, DEST, FLIGHT_NO, HOUR, ORIGIN, ROUTE, key_of
from ..sources.datamart import Star

# --- fixed values: columns each dimension adds, in join order ---
ENRICHMENT: dict[str, tuple[str, ...]] = {
    DATE: ("FlightDate", "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek"),
    HOUR: ("hhmm", "Hora", "Minuto", "TimeBlock"),
    AIRLINE: ("Airline", "Operating_Airline", "Marketing_Airline"),
    ORIGIN: ("Origin", "OriginCityName", "OriginState", "OriginStateName"),
    DEST: ("Dest", "DestCityName", "DestState", "DestStateName"),
    ROUTE: ("Origin", "Dest", "DistanceGroup"),
    AIRCRAFT: ("Tail_Number",),
    FLIGHT_NO: ("Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline"),
}
CLASH_SUFFIX = {ROUTE: "_ruta"}


def column_sources(star: Star) -> dict[str, tuple[str, str]]:
    """Added column -> (dimension, column there). A column the fact has is not added again."""
    taken = set(star.fact.columns)
    sources: dict[str, tuple[str, str]] = {}
    for dim, columns in ENRICHMENT.items():
        if key_of(dim) not in taken:
            continue
        for name in columns:
            if name not in star.dims[dim].columns:
                continue
            added = name
            if added in taken or added in sources:
                if dim not in CLASH_SUFFIX:
                    continue
                added = name + CLASH_SUFFIX[dim]
            sources[added] = (dim, name)
    return sources


def available_columns(star: Star) -> list[str]:
    """Every column a query may ask for."""
    return [*star.fact.columns, *column_sources(star)]


def add_columns(df: DataFrame, star: Star, columns: Iterable[str]) -> DataFrame:
    """Left-join the dimensions that provide ``columns``; ``df`` must hold their foreign keys."""
    sources = column_sources(star)
    wanted = [c for c in dict.fromkeys(columns) if c in sources and c not in df.columns]
    for dim in ENRICHMENT:
        mine = [c for c in wanted if sources[c][0] == dim]
        if mine:
            key = key_of(dim)
            narrow = star.dims[dim].select(key, *[F.col(sources[c][1]).alias(c) for c in mine])
            df = df.join(narrow, key, "left")
    return df


def enriched(star: Star, columns: Sequence[str] | None = None) -> DataFrame:
    """The fact with the given columns added; all of them by default."""
    return add_columns(star.fact, star, column_sources(star) if columns is None else columns)


def keys_for(star: Star, columns: Iterable[str]) -> list[str]:
    """Fact columns that determine ``columns``: their foreign keys, or themselves."""
    sources = column_sources(star)
    return list(dict.fromkeys(key_of(sources[c][0]) if c in sources else c for c in columns))
