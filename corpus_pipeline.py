"""Documents to a training mixture, one stage after another; each writes Parquet that the next one reads.

Every stage works on all that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroledger.llm.decontaminate import drop_leaks
from aeroledger.llm.jaccard import keep_one
from aeroledger.llm.language import UNDETERMINED, fit, predict
from aeroledger.llm.mixing import mix_sources
from aeroledger.llm.secret_scan import redact
from aeroledger.workspace import materialise

#: Documents of a less certain language are rejected; an ordinary text of a few words scores far above.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that can be told."""
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))  # no name of a column can clash
    scored = predict(packed, fit(docs.select("text", "lang")))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)
    return scored.where(sure).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a similarity of 0.8 on five-word shingles."""
    return keep_one(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text; all documents stay."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: what it takes of each document, in words, with the slices of every output shard."""
    return mix_sources(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
]

#: SQL cannot train the language model or repeat the hashed order of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, last = [function for _, function in STAGES]
    kept = reduce(lambda docs, function: materialise(function(spark, docs, sf_dir), "pipeline"), first, documents)
    return last(spark, kept, sf_dir)
