"""Rankings and trends by airline, airport, route and month."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.text import NO_AIRLINE, NO_ORIGIN, first_existing, month_label, route_label
from ..operators.enrich import available_columns
from ..sources.datamart import Star
from .rollup import ratio, top_n, totals_by

AIRLINE_LABELS = ("Airline", "Operating_Airline", "Marketing_Airline")


def _labels(star: Star, parts: dict[str, tuple[tuple[str, ...], str]]):
    """Label columns and the table columns they need: first existing column, null labelled."""
    names = available_columns(star)
    labels, needs = {}, []
    for label, (candidates, fallback) in parts.items():
        source = first_existing(names, candidates)
        if source is None:
            labels[label] = F.lit(fallback)
        else:
            labels[label] = F.coalesce(F.col(source).cast("string"), F.lit(fallback))
            needs.append(source)
    return labels, needs


def _limit(request: Any) -> int:
    return top_n(request if isinstance(request, Mapping) else None)


def airline_arr_delay(star: Star, request: Any = None) -> DataFrame:
    """Mean arrival delay by airline, worst first."""
    labels, needs = _labels(star, {"aerolinea": (AIRLINE_LABELS, NO_AIRLINE)})
    totals = totals_by(star, request, labels, needs, ["arr_sum", "arr_n"])
    return totals.select("aerolinea", ratio("arr_sum", "arr_n").alias("retraso_llegada_promedio")).orderBy(
        F.col("retraso_llegada_promedio").desc_nulls_last(), "aerolinea"
    )


def airline_cancellations(star: Star, request: Any = None) -> DataFrame:
    """Share of cancelled flights by airline in percent, worst first."""
    labels, needs = _labels(star, {"aerolinea": (AIRLINE_LABELS, NO_AIRLINE)})
    totals = totals_by(star, request, labels, needs, ["cancelled_sum", "n"])
    return totals.select("aerolinea", (ratio("cancelled_sum", "n") * 100).alias("cancelaciones_pct")).orderBy(
        F.col("cancelaciones_pct").desc_nulls_last(), "aerolinea"
    )


def airline_dep_delay(star: Star) -> DataFrame:
    """Mean departure delay by airline id, rows without an airline left out."""
    return (
        star.fact.where(F.col("dim_aerolinea_id").isNotNull())
        .groupBy("dim_aerolinea_id").agg(F.avg("DepDelayMinutes").alias("avg_dep_delay"))
        .orderBy("dim_aerolinea_id")
    )


def critical_airports(star: Star, request: Any = None) -> DataFrame:
    """Origins with the most departure delay in total."""
    labels, needs = _labels(star, {"origen": (("Origin",), NO_ORIGIN), "ciudad_origen": (("OriginCityName",), "")})
    totals = totals_by(star, request, labels, needs, ["dep_sum"])
    return (
        totals.select(
            "origen", "ciudad_origen", F.col("dep_sum").alias("retraso_salida_minutos"),
            (F.col("dep_sum") / 60).alias("retraso_salida_horas"),
        )
        .orderBy(F.col("retraso_salida_minutos").desc(), "origen", "ciudad_origen")
        .limit(_limit(request))
    )


def critical_routes(star: Star, request: Any = None) -> DataFrame:
    """Routes with the most departure delay in total."""
    names = available_columns(star)
    origin = first_existing(names, ("Origin", "Origin_ruta"))
    dest = first_existing(names, ("Dest", "Dest_ruta"))
    if origin is None or dest is None:
        raise ValueError("the star has no route: neither origins and destinations nor a route dimension")
    label = route_label(F.col(origin).cast("string"), F.col(dest).cast("string"))
    totals = totals_by(star, request, {"ruta": label}, [origin, dest],
                       ["dep_sum", "arr_sum", "arr_n", "cancelled_sum", "n"])
    return (
        totals.select(
            "ruta",
            F.col("dep_sum").alias("retraso_salida_minutos"),
            ratio("arr_sum", "arr_n").alias("retraso_llegada_promedio"),
            (ratio("cancelled_sum", "n") * 100).alias("cancelaciones_pct"),
            F.col("n").alias("total_flights"),
            (F.col("dep_sum") / 60).alias("retraso_salida_horas"),
        )
        .orderBy(F.col("retraso_salida_minutos").desc(), "ruta")
        .limit(_limit(request))
    )


def monthly_delay(star: Star, request: Any = None) -> DataFrame:
    """Mean delays and flights by month of the year, in calendar order; years are merged."""
    totals = totals_by(star, request, {"Month": F.col("Month")}, ["Month"],
                       ["dep_sum", "dep_n", "arr_sum", "arr_n", "n"])
    return (
        totals.where(F.col("Month").isNotNull())
        .orderBy("Month")
        .select(
            month_label(F.col("Month")).alias("mes"),
            ratio("dep_sum", "dep_n").alias("retraso_salida_promedio"),
            ratio("arr_sum", "arr_n").alias("retraso_llegada_promedio"),
            F.col("n").alias("total_flights"),
        )
    )
