"""Reduction of categories to the most frequent ones, as a stage that is saved with a model."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..workspace import materialise

# --- fixed values: how many categories each column keeps, and the name of the rest ---
KEEP_COUNTS = {"Airline": 10, "Origin": 20, "Dest": 20, "DepTimeBlk": 12, "ArrTimeBlk": 12}
OTHER = "OTHER"


def category_counts(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(name, value, count) of all values of several columns, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    return frame.select(F.inline(pairs)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))


def most_frequent(counts: DataFrame, keep: Mapping[str, int]) -> DataFrame:
    """(name, value, count, rank) of the values each column keeps; nulls take no place, ties go by name."""
    by_frequency = Window.partitionBy("name").orderBy(F.desc("count"), "value")
    ranked = counts.where("value is not null").withColumn("rank", F.row_number().over(by_frequency))
    bound = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("name")]
    # The constant bound lets Spark drop values per task before the window's shuffle.
    return ranked.where(F.col("rank") <= max(keep.values())).where(F.col("rank") <= bound)


def or_other(column: str, kept: list[str]) -> Column:
    """A kept category as it is; any other one, and null, as OTHER."""
    return F.when(F.col(column).isin(kept), F.col(column)).otherwise(OTHER).alias(column)


class TopCategoriesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces categories that were not kept at fitting time.

    The kept values are few by construction, so they are literals of a
    projection: no join, and nothing to ship besides the model itself.
    """

    keep = Param(Params._dummy(), "keep", "JSON object: column -> kept values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, keep: str = "{}") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def kept(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.keep))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = self.kept()
        return dataset.withColumns({c: or_other(c, values) for c, values in kept.items()})


class TopCategories(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the most frequent categories of several columns."""

    counts = Param(Params._dummy(), "counts", "JSON object: column -> categories to keep", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, counts: str = json.dumps(KEEP_COUNTS)) -> None:
        super().__init__()
        self._setDefault(counts=json.dumps(KEEP_COUNTS))
        self._set(**self._input_kwargs)

    def _kept_rows(self, counts: DataFrame) -> list[Row]:
        """Kept values, most frequent first: at most the sum of the bounds."""
        keep = json.loads(self.getOrDefault(self.counts))
        return most_frequent(counts, keep).orderBy("name", "rank").collect()

    def _reducer(self, kept_rows: Iterable[Row]) -> TopCategoriesModel:
        kept: dict[str, list[str]] = {c: [] for c in json.loads(self.getOrDefault(self.counts))}
        for row in kept_rows:
            kept[row["name"]].append(row["value"])
        return TopCategoriesModel(keep=json.dumps(kept, ensure_ascii=False))

    def _fit(self, dataset: DataFrame) -> TopCategoriesModel:
        columns = json.loads(self.getOrDefault(self.counts))
        return self._reducer(self._kept_rows(category_counts(dataset, columns)))


class TopCategoryIndexer(TopCategories):
    """Reduces categories and numbers what is left by frequency, learning both in one scan.

    OTHER has as many rows as the kept values do not account for, so the order
    of the reduced values is known without counting them again. Ties go by
    name; unseen values get one more number. With ``one_hot`` every column also
    gets a vector with an entry for each level but the last; the last level
    and unseen values are all zeros.
    """

    one_hot = Param(Params._dummy(), "one_hot", "whether to add one-hot vectors", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, counts: str = json.dumps(KEEP_COUNTS), one_hot: bool = False) -> None:
        given = self._input_kwargs  # the constructor above sets its own
        super().__init__()
        self._setDefault(one_hot=False)
        self._set(**given)

    def _encoders(self, levels: Mapping[str, int]) -> list:
        """One projection for the entries of all columns, and an assembler for each vector."""
        entries = {c: [f"{c}_is_{i}" for i in range(n - 1)] for c, n in levels.items()}
        flags = [f"CAST({c}_idx = {i} AS DOUBLE) AS {name}" for c, names in entries.items() for i, name in enumerate(names)]
        vectors = [VectorAssembler(inputCols=names, outputCol=f"{c}_vec") for c, names in entries.items() if names]
        return [SQLTransformer(statement=", ".join(["SELECT *", *flags]) + " FROM __THIS__"), *vectors]

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        columns = list(json.loads(self.getOrDefault(self.counts)))
        counts = materialise(category_counts(dataset, columns), "category-counts")
        rows = {r["name"]: r["n"] for r in counts.groupBy("name").agg(F.sum("count").alias("n")).collect()}
        kept_rows = self._kept_rows(counts)
        levels = {}
        indexers = []  # one per column: a model for several columns would pad its label lists to one length
        for column in columns:
            found = {r["value"]: r["count"] for r in kept_rows if r["name"] == column}
            rest = rows.get(column, 0) - sum(found.values())
            if rest:
                found[OTHER] = found.get(OTHER, 0) + rest
            labels = sorted(found, key=lambda value: (-found[value], value))
            levels[column] = len(labels)
            indexers.append(StringIndexerModel.from_labels(
                labels, inputCol=column, outputCol=f"{column}_idx", handleInvalid="keep"
            ))
        encoders = self._encoders(levels) if self.getOrDefault(self.one_hot) else []
        return PipelineModel([self._reducer(kept_rows), *indexers, *encoders])
