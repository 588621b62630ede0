"""Key figures over the filtered fact: one scan, no join."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import number_or
from ..operators.filters import filtered_fact
from ..sources.datamart import Star

# --- fixed values: limits of the status bands, and the minutes that count as late ---
LATE_MINUTES = 15
OTP_GOOD, CANCELLED_BAD, AFFECTED_BAD = 80, 5, 25

# --- fixed values: the four status buckets ---
ON_TIME, DELAYED, CANCELLED, DIVERTED = "Puntuales", "Retrasados > 15 min", "Cancelados", "Desviados"


def _share(condition: Column) -> Column:
    """Share of rows for which the condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def kpi_summary(star: Star, request: Any = None) -> DataFrame:
    """One row of key figures; zeros when no flight passes the filters."""
    facts = filtered_fact(star, request)
    dep, arr = number_or(facts, "DepDelayMinutes"), number_or(facts, "ArrDelayMinutes")
    cancelled = F.coalesce(number_or(facts, "Cancelled"), F.lit(0.0))
    diverted = F.coalesce(number_or(facts, "Diverted"), F.lit(0.0))
    affected = (arr > LATE_MINUTES) | (cancelled == 1) | (diverted == 1)
    return facts.agg(
        F.count(F.lit(1)).alias("total_flights"),
        _or_zero(F.avg(dep)).alias("retraso_salida_promedio"),
        _or_zero(F.avg(arr)).alias("retraso_llegada_promedio"),
        _or_zero(_share(arr <= LATE_MINUTES) * 100).alias("otp"),
        _or_zero(F.avg(cancelled) * 100).alias("cancelaciones_pct"),
        _or_zero(_share(affected) * 100).alias("affected_pct"),
        (_or_zero(F.sum(dep)) / 60).alias("retraso_salida_acumulado_horas"),
        (_or_zero(F.sum(arr)) / 60).alias("retraso_llegada_acumulado_horas"),
    )


def kpi_status(kpis: DataFrame) -> DataFrame:
    """The key figures with a status band each; null is neutral. Bands see rounded values."""
    otp, cancelled, affected = (
        F.round(c, 2) for c in ("otp", "cancelaciones_pct", "affected_pct")
    )
    return kpis.select(
        "*",
        F.when(otp >= OTP_GOOD, "good").otherwise("warn").alias("otp_status"),
        F.when(cancelled > CANCELLED_BAD, "bad").alias("cancelaciones_status"),
        F.when(affected > AFFECTED_BAD, "bad").otherwise("warn").alias("affected_status"),
    )


def otp_departure(star: Star) -> DataFrame:
    """Departure punctuality of the whole fact. Unlike ``otp``, a missing flag is on time."""
    late = F.coalesce(F.col("DepDel15").cast("int"), F.lit(0))
    return star.fact.agg(
        F.count(F.lit(1)).alias("n_flights"),
        F.avg(1 - late).alias("otp_departure"),
        F.avg("DepDelayMinutes").alias("avg_dep_delay"),
        F.avg(late).alias("pct_delayed15"),
    )


def metric_rows(one_row: DataFrame) -> DataFrame:
    """A one-row table of figures as (metric, value) rows."""
    names = one_row.columns
    return one_row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")


def status_distribution(star: Star, request: Any = None) -> DataFrame:
    """Flights per status and their share of the four counts.

    A flight both cancelled and diverted is in two buckets; one without an
    arrival delay that is neither is in none.
    """
    facts = filtered_fact(star, request)
    arr = number_or(facts, "ArrDelayMinutes")
    cancelled = F.coalesce(number_or(facts, "Cancelled"), F.lit(0.0))
    diverted = F.coalesce(number_or(facts, "Diverted"), F.lit(0.0))
    flown = (cancelled != 1) & (diverted != 1)
    counts = facts.agg(
        F.count_if((arr <= LATE_MINUTES) & flown).alias(ON_TIME),
        F.count_if((arr > LATE_MINUTES) & flown).alias(DELAYED),
        F.count_if(cancelled == 1).alias(CANCELLED),
        F.count_if(diverted == 1).alias(DIVERTED),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n > 0")
    buckets = [ON_TIME, DELAYED, CANCELLED, DIVERTED]
    total = sum((F.col(f"`{b}`") for b in buckets), F.lit(0))
    return (
        counts.withColumn("_total", F.greatest(total, F.lit(1)))
        .unpivot(["_total"], buckets, "categoria", "flights")
        .select("categoria", "flights", (F.col("flights") / F.col("_total") * 100).alias("porcentaje"))
    )
