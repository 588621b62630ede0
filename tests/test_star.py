from datetime import date

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from aeroledger.operators.canonical import curate
from aeroledger.operators.enrich import enriched
from aeroledger.operators.fact import LOOKUPS, build_fact, look_up_key
from aeroledger.operators.ids import first_rows, number_sorted, number_stored_rows
from aeroledger.schema import DIM_ATTRIBUTES, FACT, FACT_COLUMNS, ROW_SEQ, key_of
from aeroledger.sources.datamart import load_star, read_table, write_fact
from aeroledger.workspace import fresh_path

from .flights import landed, star_of, values


def test_ids_are_dense_and_match_a_global_row_number(spark, landing, row_key):
    numbered = number_stored_rows(landing, "n")
    rows = numbered.select("n", *row_key).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [tuple(r)[1:] for r in rows]
    assert keys == sorted(keys)


def test_numbering_follows_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("v"))
    got = number_sorted(rows.repartition(7), "n", ["v", "k"]).orderBy("n").collect()
    want = sorted(((r["v"] is None, r["v"], r["k"]) for r in rows.collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
    assert [(r["n"], r["v"], r["k"]) for r in got] == [(i + 1, v, k) for i, (_, v, k) in enumerate(want)]


@pytest.mark.parametrize("n", [1, 10, 99, 100, 500])
def test_first_rows(spark, n):
    df = spark.range(1, 300).where("id % 3 = 1").withColumn("x", F.col("id") * 2)
    got = [r["id"] for r in first_rows(df, "id", n, bits=4).collect()]
    assert got == [i for i in range(1, 300) if i % 3 == 1][:n]


def test_fact_keeps_every_row_and_points_into_dims(star, landing):
    assert star.fact.count() == landing.count()
    for dim, _, _, as_name in LOOKUPS:
        ids = star.dims[dim].select(F.col(key_of(dim)).alias("id"))
        used = star.fact.select(F.col(as_name).alias("id")).dropna()
        missing = used.join(ids, "id", "left_anti")
        assert missing.count() == 0, as_name
    for dim in DIM_ATTRIBUTES:
        ids = [r[0] for r in star.dims[dim].select(key_of(dim)).collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1)), dim


def test_duplicate_attributes(spark):
    star = star_of(
        spark,
        {"OriginCityName": "Atlanta B", "DistanceGroup": 9, "DepTimeBlk": "late"},
        {"OriginCityName": "Atlanta A", "DistanceGroup": 2},
        {"CRSDepTime": 1130, "DepTimeBlk": "departure block", "ArrTimeBlk": "x"},
    )
    # ids follow all attributes, facts point at the last row of their key
    assert values(star.dims["dim_origen"], "dim_origen_id", "OriginCityName") == [
        (1, "Atlanta"), (2, "Atlanta A"), (3, "Atlanta B")
    ]
    assert values(star.fact, "dim_origen_id") == [(3,)] * 3
    assert values(star.dims["dim_ruta"], "dim_ruta_id", "DistanceGroup") == [(1, 2), (2, 8), (3, 9)]
    assert values(star.fact, "dim_ruta_id") == [(3,)] * 3
    # the first departure block of a time wins, and departures come before arrivals
    assert values(star.dims["dim_hora"], "hhmm", "TimeBlock") == [(1130, "departure block"), (800, "late")]


def test_null_keys(spark):
    star = star_of(
        spark,
        {"Airline": None, "Tail_Number": None, "FlightDate": None, "Flight_Number_Operating_Airline": None},
        {},
        {"Origin": None, "CRSDepTime": None},
    )
    first, _, third = star.fact.orderBy("fact_id").collect()
    assert first["dim_aerolinea_id"] is None and first["dim_avion_id"] is None and first["dim_fecha_id"] is None
    assert first["dim_vuelo_id"] is None and first["Year"] is None
    assert third["dim_origen_id"] is None and third["dim_ruta_id"] is None and third["dim_hora_id"] is None
    # a pair with a null is a dimension row, in first-seen order, but is never matched
    assert values(star.dims["dim_vuelo"], "dim_vuelo_id", *DIM_ATTRIBUTES["dim_vuelo"]) == [(1, 10, None), (2, 10, 20)]


def test_first_row_of_a_date_decides(spark):
    star = star_of(spark, {"DayOfWeek": 5}, {"DayOfWeek": 1}, {"FlightDate": "2020-01-01", "DayOfWeek": None})
    assert values(star.dims["dim_fecha"], "dim_fecha_id", "FlightDate", "DayOfWeek") == [
        (1, date(2020, 1, 1), None), (2, date(2021, 3, 1), 5)
    ]


def test_lookups_do_not_depend_on_the_join_strategy(spark, curated, star):
    broadcast = values(build_fact(curated, star.dims))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = build_fact(curated, star.dims)
        assert "SortMergeJoin" in plan_of(shuffled)
        assert values(shuffled) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_build_moves_no_row(curated, star):
    plan = plan_of(build_fact(curated, star.dims))
    assert "SinglePartition" not in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_stored_star_of_another_tool(spark, star):
    """Single files, text keys, a repeated dimension key and no layout columns."""
    root = fresh_path(spark, "foreign")
    for name, dim in star.dims.items():
        dim.write.parquet(f"{root}/{name}.parquet" if name == "dim_hora" else f"{root}/{name}/{name}.parquet")
    airlines = star.dims["dim_aerolinea"]
    airlines.unionByName(airlines.where("dim_aerolinea_id = 1")).write.mode("overwrite").parquet(
        f"{root}/dim_aerolinea/dim_aerolinea.parquet"
    )
    star.fact.select(*FACT_COLUMNS).withColumns({
        "dim_aerolinea_id": F.col("dim_aerolinea_id").cast("double").cast("string"),
        "DepDelayMinutes": F.coalesce("DepDelayMinutes", F.lit(float("nan"))),
    }).write.parquet(f"{root}/{FACT}")
    foreign = load_star(spark, root)
    assert values(enriched(foreign)) == values(enriched(star).select(enriched(foreign).columns))
    with pytest.raises(FileNotFoundError):
        read_table(spark, root, "dim_nada")


def test_calendar_filter_prunes_folders(spark, star):
    plan = star.fact.where("Year = 1995 and Month > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_landing_without_a_key_keeps_scan_order(spark):
    stored = landed(spark, {"Airline": "B"}, {"Airline": "A"}, {"Airline": "C"})
    names = [r["Airline"] for r in number_stored_rows(curate(stored), "n").orderBy("n").collect()]
    assert names == ["B", "A", "C"]
    assert ROW_SEQ in stored.columns


def test_rows_without_a_date_are_written_and_read_back(spark, star):
    root = fresh_path(spark, "again")
    again = write_fact(star.fact, root)
    assert values(again, "fact_id", "Year", "Month") == values(star.fact, "fact_id", "Year", "Month")


def test_a_hot_key_of_a_large_dimension_is_split(spark, curated, star):
    """Without broadcasts, the partition of a tail number that half the flights have is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "5KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    hot = curated.withColumn("Tail_Number", F.when(F.col(ROW_SEQ) % 2 == 0, "T1").otherwise(F.col("Tail_Number")))
    # several map tasks, as a partition is split between their outputs
    hot = reduce(DataFrame.unionByName, [hot.where(F.col(ROW_SEQ) % 8 == i) for i in range(8)])
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        looked_up = look_up_key(hot.select(ROW_SEQ, "Tail_Number", "Operating_Airline"), star.dims, "dim_avion_id")
        counts = dict(values(looked_up.groupBy("dim_avion_id").count()))
        looked_up.collect()
        assert "skew=true" in plan_of(looked_up)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sum(counts.values()) == curated.count()
    assert max(counts.values()) >= curated.count() / 2
