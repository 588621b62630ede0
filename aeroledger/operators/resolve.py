"""Filter values (an id, a code or visible text) -> dimension ids."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ACCENTED, NO_FILTER_WORDS, PLAIN, norm_text


def is_blank(value: Any) -> bool:
    """True for a missing value and for the words that switch a filter off."""
    return value is None or (isinstance(value, str) and value in NO_FILTER_WORDS)


def as_int(value: Any) -> int | None:
    """A request value as an integer, truncating; None when it is not a number."""
    if is_blank(value):
        return None
    try:
        return int(float(str(value).strip()))
    except (ValueError, OverflowError):
        return None


def norm_value(value: Any) -> str:
    """The rule of ``norm_text`` for one request value."""
    folded = str(value).lower().translate(str.maketrans(ACCENTED, PLAIN))
    return " ".join(folded.split())


def _match_rank(id_col: Column, texts: Sequence[Column], value: Any) -> Column:
    """How well a dimension row matches: lower is better, null is no match.

    An id comes first, then column by column an exact and a partial match, so
    a partial match in an earlier column beats an exact one in a later column.
    """
    wanted = F.lit(norm_value(value))
    ranked = F.when(id_col == F.lit(as_int(value)), 0)
    for i, text in enumerate(texts):
        partial = (text != "") & (wanted.contains(text) | text.contains(wanted))
        ranked = ranked.when(text == wanted, 2 * i + 1).when(partial, 2 * i + 2)
    return ranked


def resolve_values(dim: DataFrame, id_col: str, match_cols: Sequence[str], values: Sequence[Any]) -> DataFrame:
    """(value, dim_id, matched) for each request value, in one scan of the dimension.

    The values of a request are few and known, so each becomes one aggregate
    (its best-ranked row, lowest id first); no pairs are formed. Without a
    match the number itself is the id, and other text gives null: no filter.
    """
    present = [c for c in match_cols if c in dim.columns]
    texts = [F.col(f"_text{i}") for i in range(len(present))]
    rows = dim.select(
        F.col(id_col).alias("_id"),
        *[norm_text(F.col(c).cast("string")).alias(f"_text{i}") for i, c in enumerate(present)],
    )
    best = []
    for i, value in enumerate(values):
        rank = F.lit(None).cast("int") if is_blank(value) else _match_rank(F.col("_id"), texts, value)
        best.append(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("_id").alias("id")))).alias(f"_v{i}"))
    results = [
        F.struct(
            F.lit(str(value)).alias("value"),
            F.coalesce(F.col(f"_v{i}.id"), F.lit(as_int(value)).cast("bigint")).alias("dim_id"),
            F.col(f"_v{i}").isNotNull().alias("matched"),
        )
        for i, value in enumerate(values)
    ]
    return rows.agg(*best).select(F.explode(F.array(*results)).alias("_r")).select("_r.*")
