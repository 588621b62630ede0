"""Foreign-key lookups and the fact table.

No join carries a broadcast hint: every lookup side is a plain scan of a written
table, so Spark knows its size and broadcasts it below its threshold. A larger
one (tail numbers, say) becomes a sort-merge join, whose hot keys AQE splits; it
can do so because nothing stands between the scan and the shuffle. Null keys are
salted, whatever the settings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..schema import (
    AIRCRAFT, AIRLINE, DATE, DEST, FACT_COLUMNS, FACT_LAYOUT, FLIGHT_NO, HOUR, ORIGIN, ROUTE, key_of,
)
from ..workspace import materialise
from .ids import number_stored_rows

# dimension, curated columns, dimension columns, foreign key in the fact
LOOKUPS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str], ...] = (
    (HOUR, ("CRSDepTime",), ("hhmm",), "dim_hora_id"),
    (HOUR, ("CRSArrTime",), ("hhmm",), "dim_hora_arr_id"),
    (AIRCRAFT, ("Tail_Number",), ("Tail_Number",), "dim_avion_id"),
    (FLIGHT_NO, ("Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline"),
     ("Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline"), "dim_vuelo_id"),
    (ORIGIN, ("Origin",), ("Origin",), "dim_origen_id"),
    (DEST, ("Dest",), ("Dest",), "dim_destino_id"),
    (ROUTE, ("Origin", "Dest"), ("Origin", "Dest"), "dim_ruta_id"),
    (AIRLINE, ("Airline",), ("Airline",), "dim_aerolinea_id"),
)


# Rows without a key are dealt to this many.
SALTS = 1024

# Dimensions with several rows per lookup key.
REPEATED = (ORIGIN, DEST, ROUTE)


def last_per_key(dim: DataFrame, dim_id: str, keys: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest id, as a written table."""
    return materialise(dim.groupBy(*keys).agg(F.max(dim_id).alias(dim_id)), f"{dim_id}-last")


def look_up(
    facts: DataFrame, dim: DataFrame, dim_id: str, on: Sequence[tuple[str, str]], as_name: str,
    carry: Sequence[str] = (), spread: str = "fact_id",
) -> DataFrame:
    """Add the id (and ``carry`` columns) of the matching dimension row, null on a miss.

    ``dim`` has one row per key, so a lookup never fans out. A null in the key
    never matches; rows that have one get a spread-out second key, so that a
    shuffle does not send all of them to one task.
    """
    keys = {f"_{as_name}_{dim_col}": dim_col for _, dim_col in on}
    narrow = dim.select(F.col(dim_id).alias(as_name), *carry, *[F.col(c).alias(k) for k, c in keys.items()])
    condition = [F.col(fact_col) == F.col(k) for (fact_col, _), k in zip(on, keys)]
    if spread in facts.columns:
        no_key = reduce(or_, [F.col(fact_col).isNull() for fact_col, _ in on])
        no_match = reduce(or_, [F.col(k).isNull() for k in keys])
        salt = F.when(no_key, 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
        condition.append(salt == F.when(no_match, F.lit(-1)).otherwise(F.lit(0)))
    return facts.join(narrow, condition, "left").drop(*keys)


def look_up_key(facts: DataFrame, dims: Mapping[str, DataFrame], as_name: str) -> DataFrame:
    """One of the lookups of the fact, by the name of its foreign key; the last dimension row wins."""
    dim, fact_cols, dim_cols, _ = next(lookup for lookup in LOOKUPS if lookup[3] == as_name)
    rows = last_per_key(dims[dim], key_of(dim), dim_cols) if dim in REPEATED else dims[dim]
    return look_up(facts, rows, key_of(dim), list(zip(fact_cols, dim_cols)), as_name)


def look_up_date(facts: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """The date lookup, which also brings the Year and Month of the date row."""
    plain = facts.drop(*FACT_LAYOUT)
    return look_up(plain, dims[DATE], key_of(DATE), [("FlightDate", "FlightDate")], key_of(DATE), FACT_LAYOUT)


def build_fact(curated: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Curated flights -> fact rows: dense id, nine foreign keys, measures, layout columns."""
    facts = look_up_date(number_stored_rows(curated, "fact_id"), dims)
    # Aircraft last: theirs may be the one join that shuffles, and rows are narrowest once the other keys stand for text.
    for *_, as_name in sorted(LOOKUPS, key=lambda lookup: lookup[0] == AIRCRAFT):
        facts = look_up_key(facts, dims, as_name)
    return facts.select(*FACT_COLUMNS, *FACT_LAYOUT)
