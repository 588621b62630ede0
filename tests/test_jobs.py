import pytest
from pyspark.sql import functions as F

from aeroledger import jobs
from aeroledger.operators.enrich import enriched
from aeroledger.plans import kpis, rankings
from aeroledger.plans.endpoints import ENDPOINTS, ask, predict
from aeroledger.sources.datamart import load_star
from aeroledger.sources.layers import sorted_by

from .flights import values


@pytest.fixture(scope="module")
def base(spark, landing, row_key, tmp_path_factory):
    """A datamart built from CSV files of the small test flights, by the job."""
    folder = tmp_path_factory.mktemp("base")
    raw = sorted_by(landing, row_key).drop("ingest_seq", *row_key)
    raw.write.option("header", True).csv(f"{folder}/inbox/flights.csv")
    jobs.build_datamart(spark, f"{folder}/inbox", str(folder))
    return str(folder)


def test_text_files_give_the_same_star(spark, base, star):
    built = load_star(spark, f"{base}/{jobs.DATAMART}")
    assert built.fact.count() == star.fact.count()
    assert values(kpis.kpi_summary(built)) == values(kpis.kpi_summary(star))
    assert values(rankings.critical_routes(built)) == values(rankings.critical_routes(star))
    assert values(enriched(built), *enriched(star).columns) == values(enriched(star))  # ids and first rows as well
    report = spark.read.parquet(f"{base}/{jobs.INGEST_REPORT}")
    assert report.where("skipped and n_rows > 0").isEmpty() and report.agg(F.sum("n_rows")).first()[0] == star.fact.count()


def test_layers_are_written(spark, base, star):
    curated = spark.read.parquet(f"{base}/{jobs.CURATED}")
    assert curated.count() == star.fact.where("dim_fecha_id is not null").count()
    assert spark.read.orc(f"{base}/{jobs.ORC}/fact_flights").count() == star.fact.count()


def test_train_and_score(spark, base):
    model, out = f"{base}/model", f"{base}/scored"
    metrics = jobs.train(spark, f"{base}/{jobs.DATAMART}", model)
    assert metrics.count() == 6
    records = f"{base}/records"
    spark.range(20).select(
        (F.col("id") * 100.0).alias("Distance"), F.lit(3).alias("DayOfWeek"), F.lit(7).alias("Month"),
        F.lit(2023).alias("Year"), F.lit("Brand#11").alias("Airline"), F.lit("N1").alias("Origin"),
        F.lit("N2").alias("Dest"), F.lit("0800-0859").alias("DepTimeBlk"), F.lit(800).alias("CRSDepTime"),
        F.lit(1100).alias("CRSArrTime"), F.lit(8).alias("DepHour"),
    ).write.parquet(records)
    jobs.score_records(spark, model, records, out)
    scored = spark.read.parquet(out)
    assert scored.count() == 20 and scored.where("prediction is null or ArrHour != 11").isEmpty()


def test_search_over_the_curated_table(spark, base):
    space = {"n_estimators": (2,), "max_depth": (3,), "min_samples_split": (2,), "min_samples_leaf": (1,), "max_features": ("sqrt",)}
    regressions = {"C": (1.0,), "class_weight": (None,)}
    report = jobs.train_curated(spark, base, f"{base}/best", space, 1, regressions, baseline_trees=2).collect()
    assert {r["model"] for r in report} == {"baseline_lr", "baseline_rf", "best_lr", "best_rf"}
    assert all(0 <= r["f1"] <= 1 for r in report)
    assert {"prediction"} <= set(predict(jobs.training.load_model(f"{base}/best"), spark.read.parquet(f"{base}/records")).columns)


def test_export(spark, base, star):
    jobs.export_csv(spark, f"{base}/{jobs.DATAMART}", "dim_aerolinea", f"{base}/export")
    assert spark.read.option("header", True).csv(f"{base}/export").count() == star.dims["dim_aerolinea"].count()


def test_every_endpoint_answers(star):
    for name in ENDPOINTS:
        assert ask(star, name, {"anio": 1995, "limit": 3}).columns
    years = [r["id"] for r in ask(star, "filters").where("list = 'years'").collect()]
    assert years == sorted(years, reverse=True) and 1995 in years
    exact = rankings.airline_arr_delay(star).first()[1]
    assert ask(star, "airline-delay").first()[1] == pytest.approx(exact, abs=0.005)
