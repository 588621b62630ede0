"""Features and classifiers for departure delays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from . import broad, forests
from .categories import KEEP_COUNTS, TopCategoryIndexer
from .frame import CATEGORICAL, LABEL, NUMERIC, SEED

INDEXED = tuple(f"{c}_idx" for c in CATEGORICAL)
ENCODED = tuple(f"{c}_vec" for c in CATEGORICAL)

# --- fixed values: parameters of the classifiers ---
LR_ITERATIONS = 30
RF_TREES, RF_DEPTH, RF_BINS = 20, 10, 32
BASELINE_LR_ITERATIONS = 1000
BASELINE_RF_TREES = 100
DEEPEST = 30  # the deepest tree Spark grows stands in for "no limit"


def index_features() -> Pipeline:
    """Reduced, indexed categories and numbers as a vector of ten features."""
    assembler = VectorAssembler(
        inputCols=[*NUMERIC, *INDEXED], outputCol="features", handleInvalid="keep"
    )
    return Pipeline(stages=[TopCategoryIndexer(), assembler])


def one_hot_features() -> Pipeline:
    """The numbers, then reduced categories as one-hot vectors without one level each.

    A column with a single level has no entry.
    """
    return Pipeline(stages=[TopCategoryIndexer(one_hot=True), EncodedAssembler()])


class EncodedAssembler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Assembles the numbers and those one-hot vectors that the columns have."""

    def _fit(self, dataset: DataFrame) -> VectorAssembler:
        encoded = [c for c in ENCODED if c in dataset.columns]
        return VectorAssembler(inputCols=[*NUMERIC, *encoded], outputCol="features", handleInvalid="keep")


def logistic_regression(iterations: int = LR_ITERATIONS, **params) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=iterations, **params)


def random_forest(trees: int = RF_TREES, depth: int = RF_DEPTH, **params) -> RandomForestClassifier:
    """Categories and the two extra indexes must fit in the bins of a split."""
    assert max(KEEP_COUNTS.values()) + 2 <= RF_BINS
    return RandomForestClassifier(
        featuresCol="features", labelCol=LABEL, numTrees=trees, maxDepth=depth, maxBins=RF_BINS, seed=SEED, **params
    )


def baseline_lr(rows: int, iterations: int = BASELINE_LR_ITERATIONS) -> LogisticRegression:
    """Unit inverse regularisation strength on unscaled features."""
    return logistic_regression(iterations, regParam=1.0 / rows, standardization=False)


def deep_forest(trees: int = BASELINE_RF_TREES, depth: int = DEEPEST, **params) -> RandomForestClassifier:
    """A forest without a limit on the depth that matters.

    Deep trees are grown in far fewer passes when the node of each row is kept
    (one integer per row and tree) and more nodes are split at a time.
    """
    return random_forest(trees, depth, cacheNodeIds=True, maxMemoryInMB=1024, **params)


def fit_models(train: DataFrame, features: Pipeline, classifiers: Mapping[str, Estimator]) -> dict[str, PipelineModel]:
    """Fit the feature stages once and every classifier on their result.

    Only the features and the label are kept while the classifiers pass over
    them; each returned model carries the feature stages, so it scores raw rows.
    """
    prepared = features.fit(train)
    vectors = prepared.transform(train).select("features", LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {
            name: PipelineModel(prepared.stages + [classifier.fit(vectors)])
            for name, classifier in classifiers.items()
        }
    finally:
        vectors.unpersist()


def baseline_models(train: DataFrame, trees: int = BASELINE_RF_TREES) -> dict[str, PipelineModel | forests.GrownForest | broad.BroadForest]:
    """The regression and the deep forest of the curated table, on the same one-hot features and all rows.

    Nodes of trees of any depth are about as many as the rows, so passes over the table for some nodes at a time do not end:
    each tree is grown whole in a task (see ``forests``), and from more than ``broad.WHOLE_ROWS`` rows what is below its first
    levels is (see ``broad``).
    """
    rows = train.count()
    regression = fit_models(train, one_hot_features(), {"baseline_lr": baseline_lr(rows)})["baseline_lr"]
    prepared = PipelineModel(regression.stages[:-1])
    grow = forests.grow if rows <= broad.WHOLE_ROWS else broad.grow
    return {"baseline_lr": regression, "baseline_rf": grow(prepared, train, trees, DEEPEST)}


def with_class_weights(frame: DataFrame) -> DataFrame:
    """Add ``weight`` so that every class weighs the same in total."""
    counts = {r[LABEL]: r["count"] for r in frame.groupBy(LABEL).count().collect()}  # one row per class
    rows = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, count in counts.items():
        weight = F.when(F.col(LABEL) == label, rows / (len(counts) * count)).otherwise(weight)
    return frame.withColumn("weight", weight)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
