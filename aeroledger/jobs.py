"""The batch jobs: build a datamart, train, score, export; from an installed wheel, or spark-submit with it in --py-files.

python -m aeroledger.jobs datamart INBOX BASE
python -m aeroledger.jobs train DATAMART MODEL
python -m aeroledger.jobs search BASE MODEL
python -m aeroledger.jobs score MODEL RECORDS OUT
python -m aeroledger.jobs export DATAMART TABLE OUT
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroledger.ml import evaluate, frame, score, search, train as training
from aeroledger.operators.canonical import curate
from aeroledger.schema import FACT, FACT_COLUMNS
from aeroledger.session import build_session
from aeroledger.sources import layers
from aeroledger.sources.datamart import Star, load_star, read_table, star_of_curated
from aeroledger.sources.ingest import ingest_with_report
from aeroledger.workspace import materialise

# --- fixed values: folders of the layers below the base path ---
LANDING = "landing/flights/flights_raw_parquet"
INGEST_REPORT = "landing/flights/ingest_report"
CURATED = "curated/flights/flights_curated_parquet"
DATAMART = "functional/datamart/parquet"
ORC = "functional/datamart/orc"


def build_datamart(spark: SparkSession, inbox: str, base: str) -> Star:
    """Raw files -> landing, curated and star tables below ``base``; the fact in ORC as well, if that can be written.

    What became of each input file is written beside the landing table.
    """
    read = ingest_with_report(spark, inbox)
    landed = layers.land(read.rows, f"{base}/{LANDING}")
    read.report.write.mode("overwrite").parquet(f"{base}/{INGEST_REPORT}")
    typed = materialise(curate(landed), "typed")
    layers.write_curated(typed, f"{base}/{CURATED}")
    star = star_of_curated(typed, f"{base}/{DATAMART}")
    layers.try_write_orc(star.fact.select(*FACT_COLUMNS), f"{base}/{ORC}/{FACT}")
    return star


def train(spark: SparkSession, datamart: str, model_path: str) -> DataFrame:
    """Fit both classifiers on the earlier years, save the forest, return the metrics of both."""
    earlier, latest = frame.temporal_split(frame.ml_frame(load_star(spark, datamart)))
    models = training.fit_models(
        earlier, training.index_features(),
        {"lr": training.logistic_regression(), "rf": training.random_forest()},
    )
    training.save_model(models["rf"], model_path)
    return reduce(DataFrame.unionByName, [
        evaluate.evaluate(model, latest).select(F.lit(name).alias("model"), "*") for name, model in models.items()
    ])


def score_records(spark: SparkSession, model_path: str, records: str, out: str) -> None:
    """Score a Parquet table of records and write it with predictions and verdicts."""
    scored = score.batch_score(training.load_model(model_path), spark.read.parquet(records))
    score.score_labels(scored).write.mode("overwrite").parquet(out)


def train_curated(
    spark: SparkSession, base: str, model_path: str, forest_space=search.RF_SPACE, draws: int = search.RF_DRAWS,
    regression_space=search.LR_SPACE, baseline_trees: int = training.BASELINE_RF_TREES,
) -> DataFrame:
    """Baselines and both searches over the curated table; saves the best forest, returns the report on held-out rows.

    Models are fitted with every row of the train part, and every held-out row counts.
    """
    rows = layers.read_curated(spark, f"{base}/{CURATED}")
    train_rows, test = frame.stratified_split(frame.curated_frame(rows))
    train_rows = materialise(train_rows, "training-rows")
    features = training.one_hot_features()
    models = training.baseline_models(train_rows, baseline_trees)
    models["best_lr"] = search.search_lr(train_rows, features, regression_space).model
    models["best_rf"] = search.search_rf(train_rows, features, forest_space, draws).model
    training.save_model(models["best_rf"], model_path)
    return evaluate.report(models, test)


def export_csv(spark: SparkSession, datamart: str, table: str, out: str) -> None:
    layers.write_csv(read_table(spark, datamart, table), out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, arguments in (
        ("datamart", ("inbox", "base")), ("train", ("datamart", "model")),
        ("search", ("base", "model")), ("score", ("model", "records", "out")), ("export", ("datamart", "table", "out")),
    ):
        command = commands.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
    args = parser.parse_args()
    spark = build_session(f"aeroledger-{args.job}")
    if args.job == "datamart":
        build_datamart(spark, args.inbox, args.base)
    elif args.job == "train":
        train(spark, args.datamart, args.model).show(truncate=False)
    elif args.job == "search":
        train_curated(spark, args.base, args.model).show(truncate=False)
    elif args.job == "score":
        score_records(spark, args.model, args.records, args.out)
    else:
        export_csv(spark, args.datamart, args.table, args.out)


if __name__ == "__main__":
    main()
