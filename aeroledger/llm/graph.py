"""Connected components of an edge table, by alternating large and small stars.

Both steps are an aggregate and a join on the node, so no neighbourhood is
gathered; each round is written, which cuts the lineage, and deleted once the
next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Round


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, kept: Round | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    The result reads a table that ``kept`` holds.
    """
    last = Round()
    now = last.write(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        between, this = Round(), Round()
        large = between.write(
            both.join(_lowest(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        small = large.join(_lowest(large), "u")
        now = this.write(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(), "edges")
        between.drop()
        last.drop()
        last = this
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    if kept is not None:
        kept.tables += last.tables
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
