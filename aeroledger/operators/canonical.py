"""Raw -> canonical -> curated: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean
from ..schema import CALENDAR_COLUMNS, CANONICAL_TYPES, FLAG_COLUMNS, ROW_SEQ


def _passthrough(df: DataFrame) -> list[str]:
    return [ROW_SEQ] if ROW_SEQ in df.columns else []


def canonical(raw: DataFrame) -> DataFrame:
    """The 39 canonical columns as they come; a missing one is null."""
    present = set(raw.columns)
    mapped = [
        F.col(name) if name in present else F.lit(None).cast(kind).alias(name)
        for name, kind in CANONICAL_TYPES.items()
    ]
    return raw.select(*mapped, *_passthrough(raw))


def _typed(df: DataFrame, name: str) -> Column:
    """A canonical column as its target type, before calendar filling."""
    c, dtype, target = F.col(name), df.schema[name].dataType, CANONICAL_TYPES[name]
    if name in FLAG_COLUMNS:
        return clean.flag(c, dtype)
    if target == "date":
        return clean.calendar_date(c, dtype)
    if target == "double":
        return clean.number(c, dtype)
    if target in ("int", "bigint"):
        return clean.whole(c, dtype, target)
    return c.cast("string")


def typed(mapped: DataFrame) -> DataFrame:
    """Every canonical column as its target type; flags 0 where unreadable."""
    columns = [_typed(mapped, name).alias(name) for name in CANONICAL_TYPES]
    return mapped.select(*columns, *_passthrough(mapped))


def fill_calendar(df: DataFrame) -> DataFrame:
    """Year, Quarter, Month and day from the flight date where missing. Not the weekday."""
    date = F.col("FlightDate")
    derived = dict(zip(CALENDAR_COLUMNS, (F.year(date), F.quarter(date), F.month(date), F.dayofmonth(date))))
    columns = []
    for name in df.columns:
        if name in derived:
            filled = F.coalesce(F.col(name), derived[name])
            columns.append(filled.alias("DayOfMonth" if name == "DayofMonth" else name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def curate(raw: DataFrame) -> DataFrame:
    """Raw flights -> cleaned canonical table."""
    return fill_calendar(typed(canonical(raw)))
