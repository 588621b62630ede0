import csv
import io
import random

import pytest

from aeroledger.sources import ingest as ingestion
from aeroledger.sources.csv_records import records


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.csv").write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def report(found):
    return {r["path"].rsplit("/", 1)[1][:-4]: (r["n_rows"], r["skipped"], r["reason"]) for r in found.report.collect()}


def test_files_are_read_whole_or_refused_with_a_reason(spark, tmp_path):
    folder = write(
        tmp_path, good="x,y\n1,2\n", ragged="x,y\n1,2\n3,4,5,6\n7,8\n", quoted_ragged='x,y\n1,"a\nb"\n3,4,"5\n"\n',
        latin="x,y\n1,".encode() + b"\xe9\n", short="x,y\n9\n", unended='x,y\n1,"never\n2,3\n', header="x,y\n", blank="\n \n",
        blanks="\n\r\n  \nx,y\n\n5,6\n\n",
    )
    found = ingestion.ingest_with_report(spark, folder)
    assert report(found) == {
        "good": (1, False, None), "ragged": (0, True, ingestion.RAGGED), "quoted_ragged": (0, True, ingestion.RAGGED),
        "latin": (0, True, ingestion.NOT_UTF8), "short": (1, False, None), "unended": (0, True, ingestion.UNENDED),
        "header": (0, False, None), "blank": (0, True, ingestion.NO_HEADER), "blanks": (1, False, None),
    }
    assert sorted((r["x"], r["y"]) for r in found.rows.collect()) == sorted([("1", "2"), ("9", None), ("5", "6")], key=str)


def test_headers_with_line_breaks_and_repeated_names(spark, tmp_path):
    folder = write(tmp_path, a='x,"two\nlines"\n1,2\n', b="k,k,K,\n1,2,3,4\n")
    rows = ingestion.ingest(spark, folder)
    assert {"x", "two\nlines", "k", "k.1", "K.2", "Unnamed: 3"} <= set(rows.columns)
    got = {tuple(v for v in (r["x"], r["two\nlines"], r["k"], r["k.1"], r["K.2"], r["Unnamed: 3"])) for r in rows.select(
        *[f"`{c}`" for c in ("x", "two\nlines", "k", "k.1", "K.2", "Unnamed: 3")]).collect()}
    assert got == {("1", "2", None, None, None, None), (None, None, "1", "2", "3", "4")}


def test_tables_without_rows_are_read(spark, tmp_path):
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "some.parquet"))
    found = ingestion.ingest_with_report(spark, str(tmp_path))
    got = {r["path"].split("/")[-2]: (r["n_rows"], r["skipped"]) for r in found.report.collect()}
    assert got == {"none.parquet": (0, False), "some.parquet": (3, False)} and found.rows.count() == 3


@pytest.mark.parametrize("size", ["200b", "1k", "1m"])
def test_records_equal_a_sequential_reader_wherever_blocks_are_cut(spark, tmp_path, size):
    r = random.Random(size)
    pieces = ["a", "bc", "x y", '""', "\n", ",", "é", "\n\n", "\r\n", '"",""']

    def field():
        return f'"{"".join(r.choices(pieces, k=r.randint(0, 9)))}"' if r.random() < 0.5 else r.choice(["", "1", "plain", "it's 5\" wide"])

    text = "a,b,c\n" + "".join(",".join(field() for _ in range(3)) + "\n" for _ in range(400))
    folder = write(tmp_path, mixed=text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = ingestion.ingest(spark, folder)
        mine = sorted((tuple(v or None for v in (x["a"], x["b"], x["c"])) for x in got.collect()), key=repr)
        cut = records(spark, [f"{folder}/mixed.csv"]).select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [tuple(v or None for v in row) for row in csv.reader(io.StringIO(text, newline="")) if row][1:]
    assert mine == sorted(want, key=repr)
    assert cut > 1 or size != "200b"
