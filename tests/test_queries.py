import pytest
from pyspark.sql import functions as F

from aeroledger.operators.filters import ALIASES, Filters, as_bool, filtered_fact, normalise, pick_aliases
from aeroledger.operators.resolve import resolve_values
from aeroledger.plans import kpis, options, rankings, tables
from aeroledger.plans.rollup import top_n
from aeroledger.sources.datamart import Star

from .flights import star_of, values


@pytest.fixture(scope="module")
def few(spark):
    """On time, just late, late, delay unknown, cancelled and diverted, cancelled."""
    return star_of(
        spark,
        {"ArrDelayMinutes": 15.0, "DepDelayMinutes": 15.0, "DepDel15": 1},
        {"ArrDelayMinutes": 15.01, "DepDelayMinutes": 16.0, "DepDel15": 1, "Airline": "DL"},
        {"ArrDelayMinutes": 60.0, "DepDelayMinutes": 50.0, "DepDel15": 1, "Airline": None, "Origin": "JFK"},
        {"ArrDelayMinutes": None, "DepDelayMinutes": 5.0},
        {"ArrDelayMinutes": None, "DepDelayMinutes": None, "DepDel15": None, "Cancelled": 1, "Diverted": 1},
        {"ArrDelayMinutes": None, "DepDelayMinutes": None, "DepDel15": None, "Cancelled": 1,
         "FlightDate": "2020-09-02", "Origin": "JFK", "OriginCityName": None},
    )


def test_kpis_count_an_unknown_delay_as_late(few):
    row = kpis.kpi_summary(few).first().asDict()
    assert row["total_flights"] == 6
    assert row["otp"] == pytest.approx(100 / 6)
    assert row["cancelaciones_pct"] == pytest.approx(200 / 6)
    assert row["affected_pct"] == pytest.approx(400 / 6)
    assert row["retraso_salida_promedio"] == pytest.approx(86 / 4)
    assert row["retraso_salida_acumulado_horas"] == pytest.approx(86 / 60)


def test_departure_punctuality_counts_a_missing_flag_as_on_time(few):
    row = kpis.otp_departure(few).first()
    assert (row["n_flights"], row["otp_departure"]) == (6, 0.5)


def test_kpis_of_nothing_are_zero(few):
    assert set(kpis.kpi_summary(few, {"year": 1900}).first()) == {0}
    assert kpis.status_distribution(few, {"year": 1900}).count() == 0
    assert rankings.airline_arr_delay(few, {"year": 1900}).count() == 0


def test_status_bands(spark):
    kpi = spark.createDataFrame(
        [(79.999, 5.0, 25.0), (79.99, 5.01, 25.01)], "otp double, cancelaciones_pct double, affected_pct double"
    )
    bands = kpis.kpi_status(kpi).select("otp_status", "cancelaciones_status", "affected_status").collect()
    assert [tuple(b) for b in bands] == [("good", None, "warn"), ("warn", "bad", "bad")]


def test_status_buckets_may_overlap_or_miss(few):
    counts = {r["categoria"]: (r["flights"], r["porcentaje"]) for r in kpis.status_distribution(few).collect()}
    assert {c: n for c, (n, _) in counts.items()} == {
        "Puntuales": 1, "Retrasados > 15 min": 2, "Cancelados": 2, "Desviados": 1
    }
    assert sum(p for _, p in counts.values()) == pytest.approx(100)


def test_status_counts_add_up(star):
    total = kpis.status_distribution(star).agg(F.sum("flights")).first()[0]
    odd = star.fact.selectExpr(
        "count_if(ArrDelayMinutes is null and Cancelled = 0 and Diverted = 0)", "count_if(Cancelled = 1 and Diverted = 1)"
    ).first()
    assert total == star.fact.count() - odd[0] + odd[1]


def test_rankings_label_missing_values(few):
    assert [tuple(r) for r in rankings.airline_arr_delay(few).collect()] == [
        ("Sin aerolínea", 60.0), ("DL", 15.01), ("AA", 15.0)
    ]
    airports = [tuple(r)[:3] for r in rankings.critical_airports(few).collect()]
    # flights point at the last row of an origin, which is the one without a city
    assert airports[0] == ("JFK", "", 50.0) and len(airports) == 2
    assert [r["ruta"] for r in rankings.critical_routes(few, {"top": 1}).collect()] == ["JFK → LAX"]


def test_a_ranking_without_a_delay_has_a_null_mean_and_comes_last(spark):
    star = star_of(spark, {"ArrDelayMinutes": None, "Airline": "ZZ"}, {"ArrDelayMinutes": 1.0})
    assert [tuple(r) for r in rankings.airline_arr_delay(star).collect()] == [("AA", 1.0), ("ZZ", None)]


def test_months_merge_years_and_keep_calendar_order(spark):
    star = star_of(
        spark, {"FlightDate": "2020-09-01"}, {"FlightDate": "2021-09-05", "DepDelayMinutes": 4.0},
        {"FlightDate": "2021-01-05"}, {"FlightDate": None},
    )
    got = [(r["mes"], r["retraso_salida_promedio"], r["total_flights"]) for r in rankings.monthly_delay(star).collect()]
    assert got == [("Enero", 0.0, 1), ("Setiembre", 2.0, 2)]
    assert [r[0] for r in options.year_options(star).collect()] == [2021, 2020]
    assert [tuple(r) for r in options.month_options(star).collect()] == [(1, "Enero"), (9, "Setiembre")]


def test_sum_over_airports_is_the_total(star):
    every = rankings.critical_airports(star, {"limit": 50})
    hours = kpis.kpi_summary(star).first()["retraso_salida_acumulado_horas"]
    assert every.agg(F.sum("retraso_salida_minutos")).first()[0] / 60 == pytest.approx(hours)


@pytest.mark.parametrize("request_, wanted", [
    ({"limit": 0}, 15), ({"limit": -3}, 1), ({"limit": "7"}, 7), ({"limit": "x"}, 15), ({"limit": 999}, 50),
    ({"top": 4}, 4), ({"limit": 3, "top": 4}, 3), ({"limit": "", "top": 5}, 5), ({}, 15), (None, 15),
])
def test_top_n(request_, wanted):
    assert top_n(request_) == wanted


def test_aliases_take_the_first_value_that_is_not_blank():
    assert pick_aliases({"anio": "", "year": "2020", "Year": 1}) == {"year": "2020"}
    assert pick_aliases({"aerolinea": "Todas", "carrier": "AA", "other": 1}) == {"airline": "AA"}
    assert set(ALIASES) == set(Filters.__dataclass_fields__)


@pytest.mark.parametrize("value, wanted", [
    (True, True), (0, False), (2, True), ("sí", True), ("No Cancelado", False), ("quizás", None), ("", None),
])
def test_flags_of_a_request(value, wanted):
    assert as_bool(value) is wanted


def test_values_resolve_in_rank_order(spark):
    dim = spark.createDataFrame(
        [(1, "AA", "Ávila"), (2, "AAL", "AA"), (3, None, "New York"), (4, "", "x")], "id bigint, code string, city string"
    )
    got = {r["value"]: (r["dim_id"], r["matched"]) for r in resolve_values(
        dim, "id", ["code", "city", "absent"],
        ["AAL", "AA", "AA - American", "avila", "new  YORK", "3", "3.9", "77", "zzz", "Todos", ""],
    ).collect()}
    assert got == {
        "AAL": (2, True), "AA": (1, True), "AA - American": (1, True), "avila": (1, True), "new  YORK": (3, True),
        "3": (3, True), "3.9": (3, True), "77": (77, False), "zzz": (None, False), "Todos": (None, False), "": (None, False),
    }


def test_a_partial_match_in_an_earlier_column_beats_an_exact_one(spark):
    dim = spark.createDataFrame([(1, "xx", "york"), (2, "york city", "b")], "id bigint, a string, b string")
    assert resolve_values(dim, "id", ["a", "b"], ["york"]).first()["dim_id"] == 2


def test_requests_become_filters(few):
    filters = normalise({"anio": "2021.0", "origen": "jfk", "cancelado": "no", "ruta": "zzz", "avion": 99}, few)
    assert filters.year == 2021 and filters.cancelled is False and filters.route is None and filters.aircraft == 99
    assert filters.origin is not None


def test_filters_combine_like_a_chain(star):
    request = {"year": 1995, "month_start": 2, "month_end": 8, "cancelled": False, "dim_aerolinea_id": 3}
    chained = star.fact.where("Year = 1995").where("Month >= 2").where("Month <= 8").where("Cancelled = 0").where(
        "dim_aerolinea_id = 3"
    )
    assert values(filtered_fact(star, request), "fact_id") == values(chained, "fact_id")
    assert filtered_fact(star).count() == star.fact.count()
    assert filtered_fact(star, {"dim_ruta_id": 10**9}).count() == 0


def test_delayed15_uses_the_flag_or_else_the_minutes(few):
    assert filtered_fact(few, {"delayed15": True}).count() == 3
    minutes = Star(few.fact.drop("DepDel15"), few.dims)
    assert filtered_fact(minutes, {"delayed15": True}).count() == 2  # 15 minutes are not more than 15
    assert filtered_fact(minutes, {"delayed15": False}).count() == 4


def test_options_follow_the_filters(few):
    every = options.filter_options(few)
    assert values(every.where("list = 'origins'"), "label") == [
        ("ATL - Atlanta - Georgia",), ("JFK - Georgia",)
    ]
    late = options.filter_options(few, {"anio": 2021, "cancelado": 1})
    assert values(late.where("list = 'airlines'"), "label") == [("AA",)]
    assert values(late.where("list = 'hours'"), "label") == [("0800-0859 - 8 - 800",)]


def test_options_read_the_fact_once(star):
    plan = options.filter_options(star)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 1


def test_rankings_aggregate_before_they_join(star):
    plan = rankings.critical_routes(star)._jdf.queryExecution().executedPlan().toString()
    first_step = plan[plan.rindex("partial_sum"):]
    assert "Join" not in first_step[:first_step.index("FileScan")]


def test_flight_table(few):
    rows = tables.flight_table(few, {"limit": 2}).collect()
    assert len(rows) == 2 and len(rows[0]) == 17 and rows[1]["Airline"] == "DL"
    assert tables.flight_table(few).count() == 6


def test_metric_rows(few):
    assert dict(values(kpis.metric_rows(kpis.otp_departure(few))))["n_flights"] == 6.0


def test_row_counts(few):
    assert dict(values(tables.star_row_counts(few)))["fact_flights"] == 6
