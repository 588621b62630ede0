"""The analytic queries by the names a dashboard asks for them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..ml import score
from ..sources.datamart import Star
from . import kpis, options, rankings, tables
from .rollup import rounded

Plan = Callable[[Star, Any], DataFrame]

# --- fixed values: names and their short aliases ---
ENDPOINTS: dict[str, Plan] = {
    "filters": options.all_options,
    "kpis": kpis.kpi_summary,
    "retraso-aerolinea": rankings.airline_arr_delay,
    "aeropuertos-criticos": rankings.critical_airports,
    "cancelaciones-aerolinea": rankings.airline_cancellations,
    "retraso-mensual": rankings.monthly_delay,
    "rutas-criticas": rankings.critical_routes,
    "flight-status": kpis.status_distribution,
    "flight-table": tables.flight_table,
}
ALIASES = {
    "airline-delay": "retraso-aerolinea",
    "critical-airports": "aeropuertos-criticos",
    "cancellations": "cancelaciones-aerolinea",
}


def predict(model: PipelineModel, records: DataFrame) -> DataFrame:
    """Result of the named query ``predict``: a table of records with the chance of a delay and a verdict."""
    return score.score_labels(score.batch_score(model, records))


def ask(star: Star, name: str, request: Mapping[str, Any] | None = None) -> DataFrame:
    """Result of a named query for a filter request, rounded for display."""
    result = ENDPOINTS[ALIASES.get(name, name)](star, request)
    return result if name == "flight-table" else rounded(result)
