"""Shared steps of the analytic queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import number_or
from ..operators.enrich import add_columns, keys_for
from ..operators.filters import filtered_fact
from ..sources.datamart import Star


def measures(facts: DataFrame) -> dict[str, Column]:
    """The additive measures every ranking is made of (null counts as nothing)."""
    dep, arr = number_or(facts, "DepDelayMinutes"), number_or(facts, "ArrDelayMinutes")
    cancelled = number_or(facts, "Cancelled")
    return {
        "dep_sum": F.coalesce(F.sum(dep), F.lit(0.0)),
        "dep_n": F.count(dep),
        "arr_sum": F.coalesce(F.sum(arr), F.lit(0.0)),
        "arr_n": F.count(arr),
        "cancelled_sum": F.coalesce(F.sum(cancelled), F.lit(0.0)),
        "n": F.count(F.lit(1)),
    }


def totals_by(star: Star, request: Any, labels: Mapping[str, Column], needs: Sequence[str],
              wanted: Sequence[str]) -> DataFrame:
    """Measure totals per label.

    The fact is aggregated by foreign key first: tasks combine their rows
    before the shuffle, and dimension columns are joined to one row per key
    instead of one per flight. Totals per key are then added up per label.
    """
    facts = filtered_fact(star, request)
    keys = keys_for(star, needs)
    every = measures(facts)
    per_key = facts.groupBy(*keys).agg(*[every[name].alias(name) for name in wanted])
    labelled = add_columns(per_key, star, needs)
    return (
        labelled.groupBy(*[c.alias(name) for name, c in labels.items()])
        .agg(*[F.sum(name).alias(name) for name in wanted])
    )


def ratio(total: str, count: str) -> Column:
    """Mean from a total and a count; null for an empty group."""
    return F.try_divide(F.col(total), F.col(count))


def rounded(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Figures as they are displayed. The queries themselves return them unrounded."""
    return df.select(*[
        F.round(f.name, decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def top_n(request: Mapping[str, Any] | None, default: int = 15, most: int = 50) -> int:
    """Row limit of a request: ``limit``, else ``top``, else the default; kept in 1..most."""
    asked = (request or {}).get("limit") or (request or {}).get("top") or default
    try:
        return max(1, min(int(asked), most))
    except (TypeError, ValueError):
        return default
