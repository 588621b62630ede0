"""Raw flights derived from the order tables of the test data.

The two steps below are shared with the SQL checks; ``{isodow}`` is their only
engine-specific token, the other braces name tables. It leaves out some canonical columns and injects nulls
by rules on keys, so that filling and null handling are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BOUND_TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")

# Unique together, so it can stand in for the order of rows in a raw file.
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

SPARK_ISODOW = "weekday(sd) + 1"
DUCKDB_ISODOW = "CAST(isodow(sd) AS INT)"

# What follows from the two nations of a flight, and from its keys.
PLACES_SQL = """         ns.n_name AS on_, nc.n_name AS dn_, rs.r_regionkey AS ork, rs.r_name AS orn,
         rc.r_regionkey AS drk, rc.r_name AS drn,
"""
RULES_SQL = """         CAST(l_orderkey % 24 AS INT) AS dh, CAST(l_partkey % 60 AS INT) AS dm,
         CAST((l_orderkey % 24 + 1 + l_suppkey % 5) % 24 AS INT) AS ah,
         (l_orderkey + l_linenumber) % 40 = 0 AS cx,
         (l_orderkey + l_linenumber) % 41 = 1 AS dv,
         CAST(CASE WHEN (l_orderkey * 7 + l_partkey * 3) % 5 < 3 THEN 0
                   ELSE (l_orderkey * 13 + l_partkey * 11 + l_linenumber * 5) % 90 END AS INT) AS dd
"""

JOINED_SQL = f"""
  SELECT l.*, CAST(l_shipdate AS DATE) AS sd, s_nationkey, c_nationkey, p_brand, p_type,
{PLACES_SQL}{RULES_SQL}  FROM {{lineitem}} l
  JOIN {{orders}} o    ON l_orderkey = o_orderkey
  JOIN {{customer}} c  ON o_custkey = c_custkey
  JOIN {{supplier}} s  ON l_suppkey = s_suppkey
  JOIN {{part}} p      ON l_partkey = p_partkey
  JOIN {{nation}} ns   ON s_nationkey = ns.n_nationkey
  JOIN {{region}} rs   ON ns.n_regionkey = rs.r_regionkey
  JOIN {{nation}} nc   ON c_nationkey = nc.n_nationkey
  JOIN {{region}} rc   ON nc.n_regionkey = rc.r_regionkey
"""

# The same rows in three steps. Customers go to orders, not to their lines; what is shuffled are keys and the two texts of a part.
KEYED_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_shipdate AS DATE) AS sd,
         s_nationkey, c_nationkey, p_brand, p_type
  FROM {lineitem} l
  JOIN (SELECT o_orderkey, c_nationkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey
  JOIN {supplier} s  ON l_suppkey = s_suppkey
  JOIN {part} p      ON l_partkey = p_partkey
"""
# The hint keeps the ranges, which a shuffle would undo. Nations and regions are few.
PLACED_SQL = f"""
  SELECT /*+ BROADCAST(ns, nc, rs, rc) */ k.*,
{PLACES_SQL.rstrip().rstrip(",")}
  FROM {{keyed}} k
  JOIN {{nation}} ns   ON s_nationkey = ns.n_nationkey
  JOIN {{region}} rs   ON ns.n_regionkey = rs.r_regionkey
  JOIN {{nation}} nc   ON c_nationkey = nc.n_nationkey
  JOIN {{region}} rc   ON nc.n_regionkey = rc.r_regionkey
"""
RULED_SQL = f"""
  SELECT *,
{RULES_SQL}  FROM {{placed}}
"""

FLIGHT_COLUMNS_SQL = """
SELECT
  CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN NULL ELSE sd END AS FlightDate,
  CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE p_brand END AS Airline,
  p_type AS Operating_Airline,
  concat('N', s_nationkey) AS Origin,
  concat('N', c_nationkey) AS Dest,
  CASE WHEN cx THEN 1 ELSE 0 END AS Cancelled,
  CASE WHEN dv THEN 1 ELSE 0 END AS Diverted,
  dh * 100 + dm AS CRSDepTime,
  ah * 100 + dm AS CRSArrTime,
  CASE WHEN cx THEN NULL ELSE CAST(dd AS DOUBLE) END AS DepDelayMinutes,
  CASE WHEN cx OR dv THEN NULL
       WHEN dd + l_linenumber - 4 < 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(dd + l_linenumber - 4 AS DOUBLE) END AS ArrDelayMinutes,
  CASE WHEN cx THEN NULL WHEN dd >= 15 THEN 1 ELSE 0 END AS DepDel15,
  CASE WHEN cx OR dv THEN NULL WHEN dd + l_linenumber - 4 >= 15 THEN 1 ELSE 0 END AS ArrDel15,
  CASE WHEN cx THEN NULL ELSE CAST(floor(dd / 15.0) AS INT) END AS DepartureDelayGroups,
  CASE WHEN cx OR dv THEN NULL ELSE CAST(floor((dd + l_linenumber - 4) / 15.0) AS INT) END AS ArrivalDelayGroups,
  CASE WHEN cx THEN NULL ELSE l_quantity * 6 END AS AirTime,
  l_quantity * 6 + 30 AS CRSElapsedTime,
  CASE WHEN cx THEN NULL ELSE l_quantity * 6 + 30 + dd END AS ActualElapsedTime,
  l_quantity * 50 AS Distance,
  CAST(floor(l_quantity / 5) AS INT) + 1 AS DistanceGroup,
  CASE WHEN l_suppkey % 11 = 3 THEN NULL ELSE concat('T', l_suppkey) END AS Tail_Number,
  l_partkey % 100 AS Flight_Number_Marketing_Airline,
  CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE l_linenumber END AS Flight_Number_Operating_Airline,
  CASE WHEN l_linenumber = 7 THEN concat(on_, ' Alt') ELSE on_ END AS OriginCityName,
  concat('R', ork) AS OriginState, orn AS OriginStateName,
  dn_ AS DestCityName, concat('R', drk) AS DestState, drn AS DestStateName,
  concat(lpad(CAST(dh AS STRING), 2, '0'), '00-', lpad(CAST(dh AS STRING), 2, '0'), '59') AS DepTimeBlk,
  concat(lpad(CAST(ah AS STRING), 2, '0'), '00-', lpad(CAST(ah AS STRING), 2, '0'), '59') AS ArrTimeBlk,
  {isodow} AS DayOfWeek,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM {joined}
"""


def flights_raw(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Raw flights over the Parquet tables in ``sf_dir``; joins are left to the optimizer.

    ``in_order`` sorts them by the row key, across partitions. The range shuffle
    then moves keys and the texts of a part; names of places come after it.
    """
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BOUND_TABLES}
    keyed = spark.sql(KEYED_SQL, **{name: tables[name] for name in ("lineitem", "orders", "customer", "supplier", "part")})
    if in_order:
        keyed = keyed.repartitionByRange(*ROW_KEY)
    placed = spark.sql(PLACED_SQL, keyed=keyed, nation=tables["nation"], region=tables["region"])
    if in_order:
        placed = placed.sortWithinPartitions(*ROW_KEY)  # a sort below the joins would be dropped as needless
    joined = spark.sql(RULED_SQL, placed=placed)
    return spark.sql(FLIGHT_COLUMNS_SQL.replace("{isodow}", SPARK_ISODOW), joined=joined)


def dirty_flights(raw: DataFrame) -> DataFrame:
    """Raw flights as CSV-like text, with unreadable values injected by a rule on keys."""
    junk = (F.col("l_orderkey") + F.col("l_partkey")) % 23

    line, day = F.col("l_linenumber"), F.col("FlightDate")
    written = (
        F.when(line == 1, F.date_format(day, "M/d/yyyy")).when(line == 2, F.date_format(day, "M/d/yyyy '12:00:00 AM'"))
        .when(line == 3, F.date_format(day, "yyyyMMdd")).when(line == 4, F.date_format(day, "dd-MMM-yyyy"))
        .when(line == 5, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(day.cast("string"))
    )

    def spoil(name: str):
        text = written if name == "FlightDate" else F.col(name).cast("string")
        return (
            F.when(junk == 0, "abc").when(junk == 1, "").when(junk == 2, "NA")
            .when(junk == 3, "NaN").when(junk == 4, F.lit(None).cast("string"))
            .when(junk == 5, "12.0").otherwise(text).alias(name)
        )

    keys = set(ROW_KEY)
    return raw.select(*[F.col(c) if c in keys else spoil(c) for c in raw.columns])
