import datetime
from collections import Counter

import pytest

from aeroledger.binding import FLIGHT_COLUMNS_SQL, JOINED_SQL, ROW_KEY, SPARK_ISODOW, flights_raw


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small order tables with null keys, keys without a match, and a supplier, a customer and a nation that come twice."""
    folder = str(tmp_path_factory.mktemp("orders"))
    day = datetime.datetime(1995, 3, 1)
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "A"), (1, "B")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "X", 0), (1, "Y", 1), (1, "Y2", 0), (None, "Z", 1), (2, "V", 7)]),
        "customer": ("c_custkey bigint, c_nationkey int", [(i, i % 3 if i % 7 else None) for i in range(40)] + [(3, 1)]),
        "supplier": ("s_suppkey bigint, s_nationkey int", [(i, i % 2) for i in range(10)] + [(4, 1), (None, 0)]),
        "part": ("p_partkey bigint, p_brand string, p_type string", [(i, f"B{i % 3}", None if i == 5 else f"T{i}") for i in range(20)]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(i, i % 45 if i % 11 else None) for i in range(300)] + [(17, 4)]),
        "lineitem": (
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp",
            [(i * 37 % 310 if i % 13 else None, i % 21, i % 11, i % 7, float(i % 50), i / 4, day + datetime.timedelta(i % 400)) for i in range(1500)]),
    }
    for name, (schema, found) in rows.items():
        spark.createDataFrame(found, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(params=[str(10 << 20), "-1"])
def threshold(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def test_raw_flights_are_those_of_the_sql_in_order(spark, tables, threshold):
    names = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")
    plain = spark.sql(JOINED_SQL, **{name: spark.read.parquet(f"{tables}/{name}.parquet") for name in names})
    expected = spark.sql(FLIGHT_COLUMNS_SQL.replace("{isodow}", SPARK_ISODOW), joined=plain)
    found = flights_raw(spark, tables, in_order=True)
    assert found.schema.names == expected.schema.names
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect())) != Counter()
    keys = [tuple(r) for r in found.select(*ROW_KEY).collect()]
    assert keys == sorted(keys)


def _below(plan, node):
    """The lines of a plan under the first node that has this text."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if node in line)
    depth = lines[at].index("Exchange")
    end = next((i for i in range(at + 1, len(lines)) if len(lines[i]) - len(lines[i].lstrip(" :+-")) <= depth), len(lines))
    return "\n".join(lines[at + 1:end])


def test_rows_are_shuffled_before_names_of_places_are_added(spark, tables, threshold):
    plan = flights_raw(spark, tables, in_order=True)._jdf.queryExecution().executedPlan().toString()
    dealt = _below(plan, "Exchange rangepartitioning(l_orderkey")
    assert "l_shipdate" in dealt and "n_name" in plan
    assert not any(name in dealt for name in ("n_name", "r_name", "rangepartitioning"))
    if threshold == "-1":  # orders, not their lines, are shuffled by customer
        by_customer = _below(plan, "Exchange hashpartitioning(o_custkey")
        assert "o_orderkey" in by_customer and "l_partkey" not in by_customer
