"""Names and types of the raw, canonical and star tables."""

from __future__ import annotations

# Position of a row in landing order; written once, see sources/layers.py.
ROW_SEQ = "ingest_seq"
# Where an ingested row was read: file name, start of its block, row in the block.
FILE_PLACE = "_file_place"

# --- fixed values: the 39 canonical columns and their types after cleaning ---
CANONICAL_TYPES = {
    "FlightDate": "date",
    "Airline": "string",
    "Operating_Airline": "string",
    "Origin": "string",
    "Dest": "string",
    "Cancelled": "bigint",
    "Diverted": "bigint",
    "DivAirportLandings": "double",
    "CRSDepTime": "int",
    "DepTime": "int",
    "CRSArrTime": "int",
    "ArrTime": "int",
    "DepDelayMinutes": "double",
    "ArrDelayMinutes": "double",
    "DepDel15": "bigint",
    "ArrDel15": "bigint",
    "DepartureDelayGroups": "double",
    "ArrivalDelayGroups": "double",
    "AirTime": "double",
    "CRSElapsedTime": "double",
    "ActualElapsedTime": "double",
    "Distance": "double",
    "DistanceGroup": "int",
    "Tail_Number": "string",
    "Flight_Number_Marketing_Airline": "bigint",
    "Flight_Number_Operating_Airline": "bigint",
    "OriginCityName": "string",
    "OriginState": "string",
    "OriginStateName": "string",
    "DestCityName": "string",
    "DestState": "string",
    "DestStateName": "string",
    "DepTimeBlk": "string",
    "ArrTimeBlk": "string",
    "Year": "int",
    "Quarter": "int",
    "Month": "int",
    "DayofMonth": "int",
    "DayOfWeek": "int",
}

# --- fixed values: flags (null counts as 0) and calendar columns filled from the date ---
FLAG_COLUMNS = ("Cancelled", "Diverted", "DepDel15", "ArrDel15")
CALENDAR_COLUMNS = ("Year", "Quarter", "Month", "DayofMonth")

# --- fixed values: star tables, their key and their attributes ---
FACT = "fact_flights"
DATE, HOUR, AIRLINE = "dim_fecha", "dim_hora", "dim_aerolinea"
ORIGIN, DEST, ROUTE = "dim_origen", "dim_destino", "dim_ruta"
AIRCRAFT, FLIGHT_NO = "dim_avion", "dim_vuelo"

DIM_ATTRIBUTES = {
    DATE: ("FlightDate", "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek"),
    HOUR: ("hhmm", "TimeBlock", "Hora", "Minuto"),
    AIRLINE: ("Airline",),
    ORIGIN: ("Origin", "OriginCityName", "OriginState", "OriginStateName"),
    DEST: ("Dest", "DestCityName", "DestState", "DestStateName"),
    ROUTE: ("Origin", "Dest", "DistanceGroup"),
    AIRCRAFT: ("Tail_Number",),
    FLIGHT_NO: ("Flight_Number_Marketing_Airline", "Flight_Number_Operating_Airline"),
}

FACT_KEYS = (
    "dim_fecha_id", "dim_hora_id", "dim_hora_arr_id", "dim_avion_id", "dim_vuelo_id",
    "dim_origen_id", "dim_destino_id", "dim_ruta_id", "dim_aerolinea_id",
)
FACT_MEASURES = (
    "Distance", "AirTime", "CRSElapsedTime", "ActualElapsedTime",
    "DepDelayMinutes", "ArrDelayMinutes", "DepDel15", "ArrDel15",
    "Cancelled", "Diverted", "DepartureDelayGroups", "ArrivalDelayGroups",
    "Operating_Airline", "DepTimeBlk", "ArrTimeBlk",
)
FACT_COLUMNS = ("fact_id", *FACT_KEYS, *FACT_MEASURES)

# Columns the stored fact is partitioned by, on top of its 25 columns: the Year
# and Month of its date row, so that calendar filters prune directories.
FACT_LAYOUT = ("Year", "Month")


def key_of(dim: str) -> str:
    """Surrogate key column of a dimension table."""
    return f"{dim}_id"
