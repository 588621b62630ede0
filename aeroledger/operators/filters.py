"""Filter requests and the predicate they stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import FALSE_WORDS, TRUE_WORDS, first_existing
from ..schema import AIRCRAFT, AIRLINE, DEST, FLIGHT_NO, HOUR, ORIGIN, ROUTE, key_of
from ..sources.datamart import Star
from .enrich import add_columns
from .resolve import as_int, is_blank, norm_value, resolve_values

# --- fixed values: the names a request may use for each filter, first non-empty wins ---
ALIASES: dict[str, tuple[str, ...]] = {
    "year": ("anio", "year", "Year", "anio_id"),
    "month": ("mes", "month", "Month", "mes_id"),
    "month_from": ("mes_inicio", "month_start", "start_month", "mes_desde"),
    "month_to": ("mes_fin", "month_end", "end_month", "mes_hasta"),
    "airline": ("aerolinea", "airline", "Airline", "dim_aerolinea_id", "carrier", "operating_airline"),
    "origin": ("origen", "origin", "Origin", "dim_origen_id", "airport_origin", "aeropuerto_origen"),
    "dest": ("destino", "dest", "Dest", "dim_destino_id", "airport_dest", "aeropuerto_destino"),
    "route": ("ruta", "route", "dim_ruta_id", "origin_dest", "origen_destino"),
    "hour": ("hora", "hour", "Hora", "dim_hora_id", "time_block", "TimeBlock", "bloque_horario"),
    "aircraft": ("avion", "tail_number", "Tail_Number", "dim_avion_id"),
    "flight": ("vuelo", "flight", "flight_number", "dim_vuelo_id"),
    "cancelled": ("cancelado", "cancelled", "Cancelled", "is_cancelled"),
    "diverted": ("desviado", "diverted", "Diverted", "is_diverted"),
    "delayed15": ("delayed15", "Delayed15", "dep15", "DepDel15", "retrasado15"),
}

# --- fixed values: columns a dimension filter is matched on, in order ---
MATCH_COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "airline": (AIRLINE, ("Airline", "Operating_Airline", "Marketing_Airline")),
    "origin": (ORIGIN, ("Origin", "OriginCityName", "OriginState", "OriginStateName")),
    "dest": (DEST, ("Dest", "DestCityName", "DestState", "DestStateName")),
    "route": (ROUTE, ("Origin", "Dest", "DistanceGroup")),
    "hour": (HOUR, ("hhmm", "Hora", "TimeBlock")),
    "aircraft": (AIRCRAFT, ("Tail_Number",)),
    "flight": (FLIGHT_NO, ("Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline")),
}

# --- fixed values: columns that tell a flight left 15 minutes late, and the fallback limit ---
DELAYED_COLUMNS = ("Delayed15", "DepDel15", "Dep15")
DELAYED_MINUTES = 15


@dataclass(frozen=True)
class Filters:
    """Active filters; dimension filters hold ids. None is inactive."""

    year: int | None = None
    month: int | None = None
    month_from: int | None = None
    month_to: int | None = None
    airline: int | None = None
    origin: int | None = None
    dest: int | None = None
    route: int | None = None
    hour: int | None = None
    aircraft: int | None = None
    flight: int | None = None
    cancelled: bool | None = None
    diverted: bool | None = None
    delayed15: bool | None = None

    def active(self) -> dict[str, int | bool]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: value for name, value in values.items() if value is not None}


def as_bool(value: Any) -> bool | None:
    """A request value as a flag; unknown text is no filter."""
    if is_blank(value):
        return None
    if isinstance(value, (bool, int, float)):
        return int(value) != 0
    word = norm_value(value)
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def pick_aliases(request: Mapping[str, Any] | None) -> dict[str, Any]:
    """Filter -> the first non-empty value among its accepted names."""
    request = request or {}
    picked = {}
    for name, aliases in ALIASES.items():
        given = [request[a] for a in aliases if a in request and not is_blank(request[a])]
        if given:
            picked[name] = given[0]
    return picked


def normalise(request: Mapping[str, Any] | Filters | None, star: Star) -> Filters:
    """A request as filters. Dimension values are looked up in one small job, if there are any."""
    if isinstance(request, Filters):
        return request
    picked = pick_aliases(request)
    parsed: dict[str, Any] = {}
    lookups = []
    for name, value in picked.items():
        if name in MATCH_COLUMNS:
            dim, match_cols = MATCH_COLUMNS[name]
            found = resolve_values(star.dims[dim], key_of(dim), match_cols, [value])
            lookups.append(found.select(F.lit(name).alias("filter"), "dim_id"))
        elif name in ("cancelled", "diverted", "delayed15"):
            parsed[name] = as_bool(value)
        else:
            parsed[name] = as_int(value)
    if lookups:  # at most one row per dimension filter
        parsed.update({r["filter"]: r["dim_id"] for r in reduce(DataFrame.unionAll, lookups).collect()})
    return Filters(**parsed)


def _flag_is(name: str, value: bool) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0)) == int(value)


def _delayed_is(columns: Sequence[str], value: bool) -> Column | None:
    flag = first_existing(columns, DELAYED_COLUMNS)
    if flag:
        return _flag_is(flag, value)
    if "DepDelayMinutes" in columns:
        late = F.coalesce(F.col("DepDelayMinutes"), F.lit(0.0)) > DELAYED_MINUTES
        return late if value else ~late
    return None


def predicate(filters: Filters, columns: Sequence[str]) -> Column | None:
    """All active filters as one condition; a filter on an absent column is ignored."""
    terms: list[Column | None] = []
    for name, value in filters.active().items():
        if name in MATCH_COLUMNS:
            key = key_of(MATCH_COLUMNS[name][0])
            terms.append(F.col(key) == value if key in columns else None)
        elif name == "year" and "Year" in columns:
            terms.append(F.col("Year") == value)
        elif name == "month" and "Month" in columns:
            terms.append(F.col("Month") == value)
        elif name == "month_from" and "Month" in columns:
            terms.append(F.col("Month") >= value)
        elif name == "month_to" and "Month" in columns:
            terms.append(F.col("Month") <= value)
        elif name == "cancelled" and "Cancelled" in columns:
            terms.append(_flag_is("Cancelled", value))
        elif name == "diverted" and "Diverted" in columns:
            terms.append(_flag_is("Diverted", value))
        elif name == "delayed15":
            terms.append(_delayed_is(columns, value))
    active = [t for t in terms if t is not None]
    return reduce(and_, active) if active else None


def filtered_fact(star: Star, request: Mapping[str, Any] | Filters | None = None,
                  columns: Sequence[str] = ()) -> DataFrame:
    """Fact rows that pass the filters, with ``columns`` added.

    Year and Month are partition columns of a fact this library has written,
    so they prune folders; for any other fact the date dimension is joined.
    """
    filters = normalise(request, star)
    calendar = [c for c, names in (("Year", ("year",)), ("Month", ("month", "month_from", "month_to")))
                if any(n in filters.active() for n in names)]
    df = add_columns(star.fact, star, calendar)
    condition = predicate(filters, df.columns)
    if condition is not None:
        df = df.where(condition)
    return add_columns(df, star, columns)
