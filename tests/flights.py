"""Small raw flights for fixtures."""

from aeroledger.sources.datamart import build_star
from aeroledger.sources.layers import land
from aeroledger.workspace import fresh_path

BASE = {
    "pos": 0, "FlightDate": "2021-03-01", "Airline": "AA", "Operating_Airline": "OO", "Origin": "ATL", "Dest": "LAX",
    "Cancelled": 0, "Diverted": 0, "CRSDepTime": 800, "CRSArrTime": 1130,
    "DepDelayMinutes": 0.0, "ArrDelayMinutes": 0.0, "DepDel15": 0, "ArrDel15": 0, "Distance": 1946.0,
    "DistanceGroup": 8, "Tail_Number": "N1", "Flight_Number_Marketing_Airline": 10,
    "Flight_Number_Operating_Airline": 20, "OriginCityName": "Atlanta", "OriginState": "GA",
    "OriginStateName": "Georgia", "DestCityName": "Los Angeles", "DestState": "CA", "DestStateName": "California",
    "DepTimeBlk": "0800-0859", "ArrTimeBlk": "1100-1159", "DayOfWeek": 1,
}
TYPES = {
    "pos": "int", "Cancelled": "int", "Diverted": "int", "CRSDepTime": "int", "CRSArrTime": "int",
    "DepDelayMinutes": "double", "ArrDelayMinutes": "double", "DepDel15": "int", "ArrDel15": "int",
    "Distance": "double", "DistanceGroup": "int", "Flight_Number_Marketing_Airline": "bigint",
    "Flight_Number_Operating_Airline": "bigint", "DayOfWeek": "int",
}


def raw_flights(spark, *changes):
    """One flight per dict of changed columns, in this order."""
    rows = [{**BASE, **change, "pos": i} for i, change in enumerate(changes)]
    schema = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in BASE)
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], schema)


def landed(spark, *changes):
    return land(raw_flights(spark, *changes), fresh_path(spark, "landing"), ["pos"])


def star_of(spark, *changes):
    return build_star(landed(spark, *changes), fresh_path(spark, "star"))


def values(df, *columns):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
