import json

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from aeroledger.ml import categories, evaluate, frame, score, search, train as training
from aeroledger.workspace import fresh_path

from .flights import values


@pytest.fixture(scope="module")
def split(star):
    return frame.temporal_split(frame.ml_frame(star))


@pytest.fixture(scope="module")
def model(split):
    return training.fit_models(split[0], training.index_features(), {"rf": training.random_forest(5, 4)})["rf"]


def test_split_is_disjoint_and_complete(star, split):
    train, valid = split
    latest = frame.ml_frame(star).agg(F.max("Year")).first()[0]
    assert {r[0] for r in valid.select("Year").distinct().collect()} == {latest}
    assert train.where(F.col("Year") >= latest).count() == 0
    assert train.count() + valid.count() == frame.ml_frame(star).count()


def test_nulls_take_no_place_and_ties_go_by_name(spark):
    df = spark.createDataFrame([(v,) for v in [None] * 5 + list("ccbbaad")], "x string")
    fitted = categories.TopCategories(counts=json.dumps({"x": 2})).fit(df)
    assert fitted.kept() == {"x": ["a", "b"]}
    assert values(fitted.transform(df).groupBy("x").count()) == [("OTHER", 8), ("a", 2), ("b", 2)]


def test_categories_are_learned_on_the_earlier_years_only(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    valid = spark.createDataFrame([("b",), ("c",)], "x string")
    fitted = categories.TopCategories(counts=json.dumps({"x": 1})).fit(train)
    assert values(fitted.transform(valid)) == [("OTHER",), ("OTHER",)]


def test_indexes_equal_a_string_indexer_on_reduced_values(spark):
    train = spark.createDataFrame([(v, "k") for v in [None] * 2 + list("ccbbaade")], "x string, y string")
    valid = spark.createDataFrame([(v, "z") for v in [None, "a", "b", "c", "zzz"]], "x string, y string")
    counts = json.dumps({"x": 2, "y": 3})
    names = dict(inputCols=["x", "y"], outputCols=["x_idx", "y_idx"])
    reducer = categories.TopCategories(counts=counts).fit(train)
    plain = StringIndexer(**names, handleInvalid="keep").fit(reducer.transform(train))
    wanted = plain.transform(reducer.transform(valid))
    got = categories.TopCategoryIndexer(counts=counts).fit(train).transform(valid)
    # y has no OTHER to learn: there it is an unseen value, and comes after the one that is known
    assert values(got) == values(wanted) and {r["y_idx"] for r in got.collect()} == {1.0}


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_quota_is_exact_per_group_and_repeatable(spark, share):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("double").alias("label"))
    chosen = df.where(frame.quota_condition(df, F.col("label"), share=share, key="k"))
    sizes = dict(values(df.groupBy("label").count()))
    assert dict(values(chosen.groupBy("label").count())) == {k: int(n * share + 0.5) for k, n in sizes.items()}
    again = df.repartition(7)
    assert values(again.where(frame.quota_condition(again, F.col("label"), share=share, key="k"))) == values(chosen)


def test_quota_is_exact_when_hashes_tie_or_slices_are_ranked_early(spark):
    df = spark.range(500).select((F.col("id") % 500).alias("k"), F.lit(1.0).alias("label"))
    for few in (1, 3, 10_000):
        assert df.where(frame.quota_condition(df, F.col("label"), rows=125, key="k", few=few)).count() == 125
    words = df.select(F.concat(F.lit("k"), "k").alias("k"), "label")
    assert words.where(frame.quota_condition(words, F.col("label"), share=0.25, key="k", few=2)).count() == 125


def test_sample_is_whole_when_the_table_is_small(spark):
    df = spark.range(100).select(F.col("id").alias("ingest_seq"))
    assert frame.ml_sample(df, rows=1000).count() == 100
    assert frame.ml_sample(df, rows=40).count() == 40
    assert values(frame.ml_sample(df, rows=40)) != values(frame.ml_sample(df, rows=40, seed=1))


def test_one_hot_drops_a_level(curated):
    rows = frame.curated_frame(curated)
    vectors = training.one_hot_features().fit(rows).transform(rows)
    length = len(vectors.select(vector_to_array("features")).first()[0])
    kept = categories.TopCategories().fit(rows).transform(rows)
    levels = sum(kept.select(c).distinct().count() for c in frame.CATEGORICAL)
    assert length == len(frame.NUMERIC) + levels - len(frame.CATEGORICAL)


def test_one_hot_of_the_last_level_and_of_unseen_values_is_zero(spark):
    train = spark.createDataFrame([("a", "k")] * 3 + [("b", "k")] * 2 + [("c", "k")], "x string, y string")
    fitted = categories.TopCategoryIndexer(counts=json.dumps({"x": 3, "y": 1}), one_hot=True).fit(train)
    got = fitted.transform(spark.createDataFrame([(v, "k") for v in "abcz"], "x string, y string"))
    assert [list(r["x_vec"].toArray()) for r in got.orderBy("x").collect()] == [[0, 0], [1, 0], [0, 1], [0, 0]]  # z is OTHER
    assert "y_vec" not in got.columns


def test_reloaded_model_scores_the_same(spark, split, model):
    path = fresh_path(spark, "model")
    training.save_model(model, path)
    loaded = training.load_model(path)
    assert loaded.stages[0].stages[0].kept() == model.stages[0].stages[0].kept()
    columns = ["label", "prediction", vector_to_array("probability").alias("p")]
    assert values(loaded.transform(split[1]).select(*columns)) == values(model.transform(split[1]).select(*columns))


def test_same_seed_same_forest(split, model):
    again = training.fit_models(split[0], training.index_features(), {"rf": training.random_forest(5, 4)})["rf"]
    trees, first = (m.stages[-1].toDebugString.split("\n", 1)[1] for m in (again, model))
    assert trees == first


def test_metrics(split, model):
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(model, split[1]).collect()}
    assert set(got) == {"auc_roc", "f1", "accuracy"} and all(0 <= v <= 1 for v in got.values())


def test_report_by_hand(spark):
    pairs = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 1 + [(0.0, 0.0)] * 4 + [(0.0, 1.0)] * 2
    report = {r["class"]: r for r in evaluate.classification_report(
        spark.createDataFrame(pairs, "label double, prediction double")
    ).collect()}
    assert report["1"]["precision"] == pytest.approx(3 / 5) and report["1"]["recall"] == pytest.approx(3 / 4)
    assert report["0"]["f1"] == pytest.approx(2 * 0.8 * (4 / 6) / (0.8 + 4 / 6)) and report["0"]["support"] == 6
    assert report["accuracy"]["f1"] == pytest.approx(0.7) and report["accuracy"]["support"] == 10
    assert report["weighted avg"]["recall"] == pytest.approx(0.7)
    assert report["macro avg"]["recall"] == pytest.approx((3 / 4 + 4 / 6) / 2)


def test_report_when_a_class_is_never_predicted(spark):
    report = {r["class"]: r for r in evaluate.classification_report(
        spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    ).collect()}
    assert report["1"]["precision"] == report["1"]["f1"] == 0


def test_batch_score_fills_defaults_and_takes_unseen_values(spark, model):
    records = spark.createDataFrame(
        [(1, 1200.0, 3, 7, 2023, "??", "ATL", "LAX", "0800-0859", 800, 1100, 8, None)],
        "id int, Distance double, DayOfWeek int, Month int, Year int, Airline string, Origin string, Dest string, "
        "DepTimeBlk string, CRSDepTime int, CRSArrTime int, DepHour int, ArrHour int",
    )
    row = score.score_labels(score.batch_score(model, records)).first()
    assert (row["id"], row["ArrHour"], row["ArrTimeBlk"]) == (1, 11, "1100-1159")
    assert row["delay_pct"] + row["on_time_pct"] == pytest.approx(100)
    assert row["verdict"] == ("DEMORADO" if row["prediction"] == 1 else "A TIEMPO")


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "label double")
    totals = dict(values(training.with_class_weights(df).groupBy("label").agg(F.sum("weight"))))
    assert totals == {0.0: pytest.approx(4), 1.0: pytest.approx(4)}


def test_draws_are_different_points_and_repeat(spark):
    points = search.draws(search.RF_SPACE, search.RF_DRAWS)
    assert len(points) == 20 and len({str(p) for p in points}) == 20
    assert points == search.draws(search.RF_SPACE, search.RF_DRAWS)
    assert len(search.grid(search.LR_SPACE)) == 8


def test_searches(split):
    train = split[0]
    small = {"n_estimators": (2,), "max_depth": (2, 3), "min_samples_split": (2,), "min_samples_leaf": (1,),
             "max_features": ("sqrt",)}
    forest = search.search_rf(train, training.index_features(), small, n_draws=2, folds=2)
    assert forest.candidates.where("best").count() == 1 and forest.candidates.count() == 2
    regression = search.search_lr(train, training.index_features(), {"C": (1.0,), "class_weight": (None, "balanced")},
                                  iterations=5, folds=2)
    assert regression.candidates.count() == 2
    final = regression.model.stages[-1]
    assert final.getOrDefault("regParam") == pytest.approx(1 / train.count())
    assert "prediction" in regression.model.transform(split[1]).columns


@pytest.mark.parametrize("values_of_score", [40, 1_000_000])
def test_roc_area_counts_every_pair(spark, values_of_score):
    rng = np.random.default_rng(values_of_score)
    label = rng.integers(0, 2, 15_000)
    score = rng.integers(0, values_of_score, 15_000) + label * values_of_score // 7
    frame_ = spark.createDataFrame([(float(y), float(s)) for y, s in zip(label, score)], "label double, score double").repartition(5)
    ones, zeros = np.sort(score[label == 1]), np.sort(score[label == 0])
    below = np.searchsorted(zeros, ones, "left") + np.searchsorted(zeros, ones, "right")
    assert evaluate.roc_area(frame_) == below.sum() / (2 * len(ones) * len(zeros))
    assert evaluate.roc_area(frame_.where("label = 1")) == evaluate.roc_area(frame_.limit(0)) == 0.0
