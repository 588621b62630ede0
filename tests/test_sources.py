import pytest
from pyspark.sql import functions as F

from aeroledger.operators.canonical import curate
from aeroledger.operators.ids import number_stored_rows
from aeroledger.schema import ROW_SEQ
from aeroledger.sources import ingest as ingestion, layers, sizes
from aeroledger.sources.datamart import read_first_rows
from aeroledger.sources.layers import land
from aeroledger.workspace import fresh_path, scratch_root

from .flights import landed, values


def inbox(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Airline,CRSDepTime,Note\nAA,800,\"x, y\"\nNA,,z\n")
    (tmp_path / "b.CSV").write_text("CRSDepTime,Airline\n12.0,BB\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("ignored")
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.csv").write_text("Airline\nZZ\n")
    spark.createDataFrame([("CC", 1530, 5.0)], "Airline string, CRSDepTime int, Distance double").coalesce(
        1
    ).write.parquet(str(tmp_path / "d.parquet"))
    return str(tmp_path)


def test_ingest_unites_by_name_and_skips_what_it_cannot_read(spark, tmp_path):
    united = ingestion.ingest(spark, inbox(spark, tmp_path))
    assert values(united, "Airline", "CRSDepTime", "Note", "Distance") == [
        ("AA", "800", "x, y", None), ("BB", "12.0", None, None), ("CC", "1530", None, 5.0), (None, None, "z", None)
    ]
    cleaned = curate(land(united, fresh_path(spark, "landing")))
    assert values(cleaned, "CRSDepTime") == [(12,), (1530,), (800,), (None,)]


def test_ingest_report_shows_what_was_skipped(spark, tmp_path):
    report = ingestion.ingest_report(spark, inbox(spark, tmp_path)).collect()
    rows = {r["path"].rsplit("/", 1)[1][:6]: r["n_rows"] for r in report}
    assert rows["a.csv"] == 2 and rows["b.CSV"] == 1 and rows["broken"] == 0 and rows["part-0"] == 1


def test_a_file_damaged_half_way_is_left_out_whole(spark, tmp_path):
    rows = spark.range(200_000).select("id", (F.col("id") * 7919 % 104729).cast("string").alias("Airline"))
    for name in ("a", "b"):
        rows.coalesce(1).write.option("parquet.block.size", 200_000).parquet(f"{tmp_path}/{name}")
    inside = tmp_path / "in"
    inside.mkdir()
    for name in ("a", "b"):
        part = next((tmp_path / name).glob("*.parquet")).read_bytes()
        (inside / f"{name}.parquet").write_bytes(part if name == "a" else part[:len(part) // 2] + b"\xff" * 4000 + part[len(part) // 2 + 4000:])
    found = ingestion.ingest_with_report(spark, str(inside))
    assert found.rows.count() == 200_000
    report = {r["path"][-9:]: (r["n_rows"], r["skipped"]) for r in found.report.collect()}
    assert report == {"a.parquet": (200_000, False), "b.parquet": (0, True)}


def test_quoted_line_breaks_stay_in_their_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,Note\n1,"two\nlines"\n2,"a ""word"""\n')
    (tmp_path / "b.csv").write_text("x,Note\n3,plain\n")
    assert values(ingestion.ingest(spark, str(tmp_path)), "x", "Note") == [("1", "two\nlines"), ("2", 'a "word"'), ("3", "plain")]


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    for name, n in (("a", 10), ("b", 30_000), ("c", 200)):
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        stored = land(ingestion.ingest(spark, str(tmp_path)), fresh_path(spark, "ordered"))
        got = [r["k"] for r in number_stored_rows(stored, "n").orderBy("n").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{name}{i}" for name, n in (("a", 10), ("b", 30_000), ("c", 200)) for i in range(n)]


def test_first_row_of_a_repeated_key_stays(spark, tmp_path):
    rows = [(1, "Z"), (1, None), (1, "A"), (2, None), (2, "B")]
    spark.createDataFrame(rows, "dim_aerolinea_id int, Airline string").coalesce(1).write.parquet(f"{tmp_path}/dim_aerolinea")
    assert values(read_first_rows(spark, str(tmp_path), "dim_aerolinea"), "dim_aerolinea_id", "Airline") == [(1, "Z"), (2, None)]


def test_a_failed_orc_copy_is_not_the_end(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    assert layers.try_write_orc(spark.range(3), f"{tmp_path}/ok")
    assert not layers.try_write_orc(spark.range(3), f"{tmp_path}/file/orc")


def test_parquet_files_that_disagree_on_a_type(spark, tmp_path):
    for name, kind in (("a", "int"), ("b", "string")):
        spark.range(1).select(F.col("id").cast(kind).alias("v")).write.parquet(f"{tmp_path}/{name}.parquet")
    assert values(ingestion.ingest(spark, str(tmp_path)), "v") == [("0",), ("0",)]


def test_curated_rows_without_year_or_month_are_not_written(spark):
    stored = landed(spark, {}, {"FlightDate": None}, {"FlightDate": "2020-02-02"})
    curated = curate(stored).withColumn("Month", F.when(F.col("Year") == 2021, F.col("Month")))
    path = fresh_path(spark, "curated")
    layers.write_curated(curated, path)
    back = layers.read_curated(spark, path)
    assert values(back, "Year", "Month") == [(2021, 3)]
    plan = back.where("Year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_sample_takes_the_first_rows(spark):
    stored = landed(spark, *[{"Airline": f"A{i}"} for i in range(9)])
    path = fresh_path(spark, "sample")
    layers.csv_sample(curate(stored), path, rows=4)
    back = spark.read.option("header", True).csv(path)
    assert values(back, "Airline") == [("A0",), ("A1",), ("A2",), ("A3",)]
    assert ROW_SEQ not in back.columns


def test_sizes_and_times(spark, star):
    root = fresh_path(spark, "formats")
    layers.write_tables({"t": star.fact}, f"{root}/parquet")
    layers.write_orc(star.fact, f"{root}/orc/t")
    paths = {"parquet": f"{root}/parquet/t", "orc": f"{root}/orc/t"}
    first, second = sizes.format_size_report(spark, paths).orderBy(F.desc("format")).collect()
    assert first["saving_pct"] == 0 and first["bytes"] > 0
    assert second["saving_pct"] == (1 - second["bytes"] / first["bytes"]) * 100
    assert sizes.time_read_aggregate(spark, paths, runs=2).count() == 4


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_the_damaged_file_of_a_table_folder_is_left_out(spark, tmp_path):
    table = tmp_path / "flights.parquet"
    spark.range(3000).select("id", (F.col("id") % 3).alias("Month")).repartition(1).write.partitionBy("Month").parquet(str(table))
    (tmp_path / "one.parquet").write_bytes(next(table.glob("Month=0/*.parquet")).read_bytes())
    part = next(table.glob("Month=1/*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:10] + b"\xff" * (len(whole) // 2) + whole[10 + len(whole) // 2:])
    (table / "Month=1" / f".{part.name}.crc").unlink()
    rows = ingestion.ingest(spark, str(tmp_path))
    assert set(values(rows.groupBy("Month").agg(F.count("id")), "Month", "count(id)")) == {(None, 1000), (0, 1000), (2, 1000)}


def test_a_read_error_after_the_check_fails_the_job(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    inside = tmp_path / "in"
    inside.mkdir()
    for name in ("a", "b"):
        (inside / f"{name}.parquet").write_bytes(next((tmp_path / name).glob("*.parquet")).read_bytes())
    rows = ingestion.ingest(spark, str(inside))
    whole = (inside / "b.parquet").read_bytes()
    (inside / "b.parquet").write_bytes(whole[:10] + b"\xff" * (len(whole) // 2) + whole[10 + len(whole) // 2:])
    with pytest.raises(Exception):
        rows.agg(F.sum("id")).collect()
