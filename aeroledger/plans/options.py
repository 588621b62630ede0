"""What a user can choose in a filter."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.text import joined_label, month_label
from ..operators.filters import filtered_fact
from ..schema import AIRLINE, DATE, DEST, HOUR, ORIGIN, ROUTE, key_of
from ..sources.datamart import Star

# --- fixed values: lists offered, their dimension and the columns of the label ---
OPTION_LISTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "airlines": (AIRLINE, ("Airline", "Operating_Airline")),
    "origins": (ORIGIN, ("Origin", "OriginCityName", "OriginStateName")),
    "destinations": (DEST, ("Dest", "DestCityName", "DestStateName")),
    "routes": (ROUTE, ("Origin", "Dest", "DistanceGroup")),
    "hours": (HOUR, ("TimeBlock", "Hora", "hhmm")),
}


def filter_options(star: Star, request: Any = None) -> DataFrame:
    """(list, id, label) for the dimension rows that occur in the filtered fact.

    One scan collects the ids of all lists: each flight yields one (list, id)
    per list, which tasks reduce to distinct pairs before the shuffle. Pairs
    are distinct on both sides, so an inner join keeps rows as a semi-join
    would; a semi-join would be pushed into the union and scan once per list.
    """
    facts = filtered_fact(star, request)
    lists = {name: spec for name, spec in OPTION_LISTS.items() if key_of(spec[0]) in facts.columns}
    pairs = F.array(*[
        F.struct(F.lit(name).alias("list"), F.col(key_of(dim)).alias("id")) for name, (dim, _) in lists.items()
    ])
    present = facts.select(F.inline(pairs)).where("id is not null").distinct()

    def labelled(name: str, dim: str, columns: tuple[str, ...]) -> DataFrame:
        rows, key = star.dims[dim], F.col(key_of(dim))
        parts = [F.col(c) for c in columns if c in rows.columns]
        return rows.select(F.lit(name).alias("list"), key.alias("id"), joined_label(parts, key).alias("label"))

    options = reduce(DataFrame.unionByName, [labelled(n, dim, cols) for n, (dim, cols) in lists.items()])
    return options.join(present, ["list", "id"]).orderBy("list", "label", "id")


def all_options(star: Star, request: Any = None) -> DataFrame:
    """The option lists with the years (latest first) and months in front, in the order they are shown."""
    years = year_options(star).select(
        F.lit("years").alias("list"), F.col("year").cast("bigint").alias("id"), F.col("year").cast("string").alias("label"),
        (-F.col("year")).alias("_order"),
    )
    months = month_options(star).select(
        F.lit("months").alias("list"), F.col("month").cast("bigint").alias("id"), "label", F.col("month").alias("_order")
    )
    dims = filter_options(star, request).withColumn("_order", F.lit(0))
    return years.unionByName(months).unionByName(dims).orderBy("list", "_order", "label", "id").drop("_order")


def year_options(star: Star) -> DataFrame:
    """Years of the calendar, latest first; filters do not matter."""
    years = star.dims[DATE].select(F.col("Year").alias("year")).dropna().distinct()
    return years.orderBy(F.col("year").desc())


def month_options(star: Star) -> DataFrame:
    """Months of the calendar with their names, in order; filters do not matter."""
    months = star.dims[DATE].select(F.col("Month").alias("month")).dropna().distinct()
    return months.select("month", month_label(F.col("month")).alias("label")).orderBy("month")
