from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from aeroledger.functions import clean, text
from aeroledger.operators.canonical import canonical, curate, typed
from aeroledger.schema import CANONICAL_TYPES

from .flights import raw_flights, values

JUNK = ["abc", "", "12.0", "NA", "NaN", None, "7", " 8 ", "1e2", "12d", "0x1p3", "-3.9"]


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, c {kind}")


def evaluate(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_number_reads_decimal_notation_only(spark):
    df = column(spark, JUNK)
    got = evaluate(df, clean.number(F.col("c"), T.StringType()))
    assert got == [None, None, 12.0, None, None, None, 7.0, 8.0, 100.0, None, None, -3.9]


def test_number_turns_nan_into_null(spark):
    df = column(spark, [1.5, float("nan"), None], "double")
    assert evaluate(df, clean.number(F.col("c"), T.DoubleType())) == [1.5, None, None]


def test_whole_goes_through_double_and_truncates(spark):
    df = column(spark, JUNK)
    got = evaluate(df, clean.whole(F.col("c"), T.StringType(), "int"))
    assert got == [None, None, 12, None, None, None, 7, 8, 100, None, None, -3]


def test_flag_is_never_null(spark):
    df = column(spark, ["1", "1.0", "abc", "", "NaN", None])
    assert evaluate(df, clean.flag(F.col("c"), T.StringType())) == [1, 1, 0, 0, 0, 0]


def test_dates(spark):
    df = column(spark, ["2021-03-01", "bad", "", "12.0", None, "2021-02-30", "2021-03-01 10:00:00"])
    got = evaluate(df, clean.calendar_date(F.col("c"), T.StringType()))
    assert got == [date(2021, 3, 1), None, None, None, None, None, date(2021, 3, 1)]


def test_other_ways_to_write_a_date(spark):
    same = ["3/1/2021", "3/1/2021 12:00:00 AM", "20210301", "01-Mar-2021", "1 MAR 2021", "Mar 1, 2021", "2021/3/1", "03-01-2021",
            " 2021-03-01T10:00:00.5 ", "20210301 09:30"]
    df = column(spark, [*same, "13/13/2021", "20211301", "1/2", "31-Foo-2021", "99999999"])
    got = evaluate(df, clean.calendar_date(F.col("c"), T.StringType()))
    assert got == [date(2021, 3, 1)] * len(same) + [None] * 5
    assert evaluate(column(spark, [20210301, 7, None], "int"), clean.calendar_date(F.col("c"), T.IntegerType())) == [date(2021, 3, 1), None, None]


def test_hhmm(spark):
    df = column(spark, [0, 5, 59, 100, 1530, 2400, None], "int")
    hour, minute = clean.hhmm_parts(F.col("c"))
    assert evaluate(df, hour) == [0, 0, 0, 1, 15, 24, None]
    assert evaluate(df, minute) == [0, 5, 59, 0, 30, 0, None]
    assert evaluate(df, clean.hour_bucket(F.col("c"))) == [0, 0, 0, 1, 15, 24, None]


def test_csv_null_words(spark):
    df = column(spark, ["NA", "null", "", "NaN", "Nada", None])
    assert evaluate(df, clean.null_words_to_null(F.col("c"))) == [None, None, None, None, "Nada", None]


def test_canonical_has_39_columns_whatever_comes_in(spark):
    mapped = canonical(raw_flights(spark, {}).select("Airline", "pos"))
    assert mapped.columns == list(CANONICAL_TYPES) and len(mapped.columns) == 39
    assert typed(mapped).schema["Cancelled"].dataType == T.LongType()


def test_calendar_is_filled_but_not_the_weekday(spark):
    raw = raw_flights(spark, {"DayOfWeek": None}, {"FlightDate": "x"}).withColumn(
        "Year", F.when(F.col("pos") == 1, 1999)
    )
    got = values(curate(raw), "FlightDate", "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek")
    assert got == [(None, 1999, None, None, None, 1), (date(2021, 3, 1), 2021, 1, 3, 1, None)]


@pytest.mark.parametrize("given, wanted", [
    ("  Línea   ÁREA ", "linea area"), ("Ñandú", "nandu"), ("a\t b\n c", "a b c"), (None, ""), ("ÜBER", "uber"),
])
def test_norm_text(spark, given, wanted):
    assert evaluate(column(spark, [given]), text.norm_text(F.col("c"))) == [wanted]


def test_parse_values(spark):
    df = column(spark, ["12.7", "sí", "no  cancelado", "Todos", "", "abc", "0", "1", None])
    assert evaluate(df, text.parse_int(F.col("c"))) == [12, None, None, None, None, None, 0, 1, None]
    assert evaluate(df, text.parse_float(F.col("c")))[0] == 12.7
    assert evaluate(df, text.parse_bool(F.col("c"))) == [None, True, False, None, None, None, False, True, None]


def test_month_label(spark):
    df = column(spark, [1, 9, 13, None], "int")
    assert evaluate(df, text.month_label(F.col("c"))) == ["Enero", "Setiembre", "13", None]


def test_label_picks_a_column_not_a_value(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert df.select(text.label_or(df, ["z", "a", "b"], "none")).first()[0] == "none"
    assert df.select(text.label_or(df, ["z"], "none")).first()[0] == "none"
    assert df.select(text.number_or(df, "z", 3)).first()[0] == 3.0


def test_joined_label(spark):
    df = spark.createDataFrame([("ATL", "Atlanta", "ATL"), (None, " ", None)], "a string, b string, c string")
    got = df.select(text.joined_label([F.col("a"), F.col("b"), F.col("c")], F.lit(7))).collect()
    assert [r[0] for r in got] == ["ATL - Atlanta", "7"]


def test_match_columns_tries_patterns_in_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Carrier int, DepDelay int, ArrDelay int")
    assert text.match_columns(df, ["^arr", "delay"]) == "ArrDelay"
    assert text.match_columns(df, ["delay"]) == "DepDelay"
    assert text.match_columns(df, ["tail"]) is None
