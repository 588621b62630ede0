"""Text rules shared by filters, labels and options."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .clean import number

# --- fixed values: accents that are folded, and words that mean "no filter" ---
ACCENTED = "áéíóúäëïöüñ"
PLAIN = "aeiouaeioun"
NO_FILTER_WORDS = ("", "Todos", "Todas", "All")

# --- fixed values: words read as true and as false ---
TRUE_WORDS = (
    "1", "true", "t", "si", "yes", "y",
    "cancelado", "divertido", "delayed", "retrasado",
)
FALSE_WORDS = (
    "0", "false", "f", "no", "n",
    "no cancelado", "no divertido", "puntual", "on time",
)

# --- fixed values: month names and the labels of missing values ---
MONTH_NAMES = {
    1: "Enero", 2: "Febrero", 3: "Marzo", 4: "Abril",
    5: "Mayo", 6: "Junio", 7: "Julio", 8: "Agosto",
    9: "Setiembre", 10: "Octubre", 11: "Noviembre", 12: "Diciembre",
}
NO_AIRLINE = "Sin aerolínea"
NO_ORIGIN = "Sin origen"
NO_DEST = "Sin destino"
ROUTE_ARROW = " → "


def norm_text(c: Column) -> Column:
    """Lower case, accents folded, white space collapsed; null -> ""."""
    folded = F.translate(F.lower(c), ACCENTED, PLAIN)
    return F.coalesce(F.trim(F.regexp_replace(folded, r"(?U)\s+", " ")), F.lit(""))


def parse_float(c: Column) -> Column:
    """Filter text -> double; a "no filter" word or unknown text -> null."""
    return F.when(~c.isin(*NO_FILTER_WORDS), number(c, T.StringType()))


def parse_int(c: Column) -> Column:
    """Filter text -> bigint through double, so "12.7" -> 12."""
    return parse_float(c).try_cast("bigint")


def parse_bool(c: Column) -> Column:
    """Filter text -> boolean by word list; unknown -> null."""
    word = norm_text(c)
    return (
        F.when(c.isNull() | c.isin(*NO_FILTER_WORDS), F.lit(None).cast("boolean"))
        .when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
    )


def month_label(month: Column) -> Column:
    """Month number -> name; an unknown number is shown as text."""
    names = F.create_map(*[F.lit(x) for pair in MONTH_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, month.cast("int")), month.cast("string"))


def route_label(origin: Column, dest: Column) -> Column:
    """ "origin → destination", with a fixed label for a missing end."""
    return F.concat(
        F.coalesce(origin, F.lit(NO_ORIGIN)), F.lit(ROUTE_ARROW), F.coalesce(dest, F.lit(NO_DEST))
    )


def joined_label(parts: Sequence[Column], fallback: Column) -> Column:
    """Distinct non-empty parts joined by " - "; ``fallback`` when none is left."""
    texts = F.array(*[F.trim(p.cast("string")) for p in parts])
    kept = F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, " - ")).otherwise(fallback.cast("string"))


def first_existing(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that is a column name; it picks a column, not a value per row."""
    return next((name for name in candidates if name in columns), None)


def label_or(df: DataFrame, candidates: Sequence[str], fallback: str) -> Column:
    """The first existing candidate with nulls labelled, or the label for every row."""
    name = first_existing(df.columns, candidates)
    if name is None:
        return F.lit(fallback)
    return F.coalesce(F.col(name).cast("string"), F.lit(fallback))


def number_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A numeric column as double, or a constant when the table does not have it."""
    return F.col(name).cast("double") if name in df.columns else F.lit(float(default))


def match_columns(df: DataFrame, patterns: Sequence[str]) -> str | None:
    """First column that a pattern matches (ignoring case), patterns in order."""
    for pattern in patterns:
        found = [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
        if found:
            return found[0]
    return None
