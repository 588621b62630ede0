"""Column expressions that turn raw values into typed ones; bad input becomes null.

Each takes the column and its Spark type, so that a column which is already
typed costs nothing beyond a cast.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values: words that the usual CSV readers treat as missing ---
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Decimal or exponent notation only: Java would also read "12d" and hex floats.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def null_words_to_null(c: Column) -> Column:
    """Text read from CSV -> null where it spells a missing value."""
    return F.when(~c.isin(*NULL_WORDS), c)


def nan_to_null(c: Column) -> Column:
    """NaN means missing, and would otherwise compare greater than any number."""
    return F.when(~F.isnan(c), c)


def number(c: Column, dtype: T.DataType) -> Column:
    """Any column -> double, unparseable -> null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(_NUMBER), F.trim(c)).try_cast("double")
    return c.try_cast("double")


def whole(c: Column, dtype: T.DataType, target: str = "bigint") -> Column:
    """Any column -> integer type through double ("12.0" -> 12), truncating."""
    if isinstance(dtype, T.IntegralType):
        return c.try_cast(target)
    return number(c, dtype).try_cast(target)


def flag(c: Column, dtype: T.DataType) -> Column:
    """0/1 flag that is never null: anything unreadable counts as 0."""
    return F.coalesce(whole(c, dtype), F.lit(0).cast("bigint"))


# --- fixed values: how dates are written, besides ISO; the first shape that fits decides the pattern ---
DATE_SHAPES = (
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
)
_TIME_OF_DAY = r"[ T]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?( *[AaPp][Mm])?$"


def calendar_date(c: Column, dtype: T.DataType) -> Column:
    """Any column -> date, unparseable -> null; a time of day is dropped, month comes before day."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.try_cast("date")
    if isinstance(dtype, T.IntegralType):  # 20210301
        c, dtype = c.cast("string"), T.StringType()
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("date")
    day = F.regexp_replace(F.trim(c), _TIME_OF_DAY, "")
    parsed = F.when(~day.rlike("^[0-9]+$"), day.try_cast("date"))
    for shape, pattern in reversed(DATE_SHAPES):
        text = F.initcap(day) if "MMM" in pattern else day
        parsed = F.when(day.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("date")).otherwise(parsed)
    return parsed


def hhmm_parts(hhmm: Column) -> tuple[Column, Column]:
    """HHMM number -> (hour, minute); 2400 is hour 24, minute 0."""
    digits = hhmm.cast("int").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.substring(padded, 1, 2).try_cast("int"), F.substring(padded, 3, 10).try_cast("int")


def hour_bucket(hhmm: Column) -> Column:
    """HHMM number -> hour, by truncating division."""
    return (hhmm / 100).cast("int")
