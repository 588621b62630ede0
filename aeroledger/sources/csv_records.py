"""Records of CSV files from lines, so that a file with line breaks in quotes is split like any other.

Whether a line starts inside quotes is only known once all lines before it are. So each line is read both ways: begun
outside and begun inside a quoted value, it tells whether the value is open at its end and how many separators count.
These two-way answers are composed, first over the lines of a block, then over the blocks of a file, which gives the
state every line really begins with, and with it the lines and the number of fields of every record.

A quote opens a value only at the start of a field; a doubled quote inside stands for one. What follows a closing quote up
to the separator is taken as it is. An empty line outside quotes is no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..workspace import materialise

_QUOTED = r'"(?:[^"]|"")*+"'
_FIELD_START = r'(^|,)'


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _from_outside(line: Column) -> tuple[Column, Column]:
    """(whether a quoted value is open at the end, separators) of a line that begins outside quotes."""
    rest = F.regexp_replace(line, _FIELD_START + _QUOTED, "$1")
    opens = rest.rlike(_FIELD_START + '"')
    before = F.regexp_replace(rest, f'(?s){_FIELD_START}".*$', "$1")
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, opens).otherwise(False), F.when(quoted, _commas(before)).otherwise(_commas(line))


def _from_inside(line: Column) -> tuple[Column, Column]:
    """The same of a line that begins inside a quoted value."""
    close = r'^(?:[^"]|"")*+"'
    opens, commas = _from_outside(F.regexp_replace(line, close, ""))
    closes = line.rlike(close)
    return F.when(closes, opens).otherwise(True), F.when(closes, commas).otherwise(0)


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, block, row, value, open_0, commas_0, open_1, commas_1): lines and what they are, begun outside and inside quotes."""
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    # A return at the end of a line belongs to its break.
    plain = F.regexp_replace("value", r"\r$", "")
    (open_0, commas_0), (open_1, commas_1) = _from_outside(plain), _from_inside(plain)
    return lines.select("*", open_0.alias("open_0"), commas_0.alias("commas_0"), open_1.alias("open_1"), commas_1.alias("commas_1"))


def _composed(df: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds ``end_0`` and ``end_1``: the state after a row, if the first row of its group began outside, or inside, quotes.

    A row that ends alike both ways sets the state, one that ends as it began keeps it, the third kind turns it over. So
    the state is that of the last row that sets it, turned over by the rows since.
    """
    up_to = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*within, "setting").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sets = (F.col("open_0") == F.col("open_1")).cast("int")
    turns = (F.col("open_0") & ~F.col("open_1")).cast("int")
    turned = df.withColumn("setting", F.sum(sets).over(up_to)).withColumn("turns", F.sum(turns).over(since) % 2 == 1)
    turned = turned.withColumn("set", F.first("open_0").over(since))

    def end(begin: bool) -> Column:
        return F.when(F.col("setting") > 0, F.col("set") != F.col("turns")).otherwise(F.lit(begin) != F.col("turns"))

    return turned.withColumns({"end_0": end(False), "end_1": end(True)}).drop("setting", "turns", "set")


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, number, block, row, text, fields) of every record, in the order of their numbers in a file.

    A file whose last quoted value has no end gives no records: all that follows the quote would be one.
    """
    lines = materialise(_composed(read_lines(spark, files), ["path", "block"], "row"), "csv-lines")
    blocks = lines.groupBy("path", "block").agg(
        F.max_by("end_0", "row").alias("open_0"), F.max_by("end_1", "row").alias("open_1"),
        F.count_if(~F.col("end_0")).alias("ends_0"), F.count_if(~F.col("end_1")).alias("ends_1"))
    by_block = Window.partitionBy("path").orderBy("block")
    blocks = _composed(blocks, ["path"], "block").withColumn("inside", F.lag("end_0", 1, False).over(by_block))
    ends = F.when(F.col("inside"), F.col("ends_1")).otherwise(F.col("ends_0"))
    blocks = blocks.withColumn("ended", F.coalesce(F.sum(ends).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("unended", F.last("end_0").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = materialise(blocks.where("NOT unended").select("path", "block", "inside", F.col("ended").alias("records_before")), "csv-blocks")

    in_block = Window.partitionBy("path", "block").orderBy("row")
    known = lines.join(starts, ["path", "block"]).withColumn(
        "open", F.when(F.col("inside"), F.col("end_1")).otherwise(F.col("end_0")))
    known = known.withColumn("begun", F.coalesce(F.lag("open").over(in_block), F.col("inside")))
    before = F.coalesce(F.count_if(~F.col("open")).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.select(
        "path", (F.col("records_before") + before).alias("number"), "block", "row", "value", "open",
        F.when(F.col("begun"), F.col("commas_1")).otherwise(F.col("commas_0")).alias("commas"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), r"\r$", "")
    whole = known.groupBy("path", "number").agg(
        parts.alias("parts"), (F.sum("commas") + 1).alias("fields"))
    return whole.select(
        "path", "number", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["row"].alias("row"),
        text.alias("text"), "fields").where(F.trim("text") != "")
