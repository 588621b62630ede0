"""Independent SQL for the registered queries, in the dialect of DuckDB.

Only the derivation of raw flights is shared with the Spark side. Each query is
written against the named steps below; ``_sql`` prepends the steps it uses.
"""

from __future__ import annotations

import re

from ..binding import BOUND_TABLES, DUCKDB_ISODOW, FLIGHT_COLUMNS_SQL, JOINED_SQL, ROW_KEY

KEY = ", ".join(ROW_KEY)

MONTH_CASE = """CASE {m} WHEN 1 THEN 'Enero' WHEN 2 THEN 'Febrero' WHEN 3 THEN 'Marzo' WHEN 4 THEN 'Abril'
  WHEN 5 THEN 'Mayo' WHEN 6 THEN 'Junio' WHEN 7 THEN 'Julio' WHEN 8 THEN 'Agosto' WHEN 9 THEN 'Setiembre'
  WHEN 10 THEN 'Octubre' WHEN 11 THEN 'Noviembre' WHEN 12 THEN 'Diciembre' ELSE CAST({m} AS VARCHAR) END"""

STEPS: dict[str, str] = {
    "joined": JOINED_SQL.format(**{t: t for t in BOUND_TABLES}),
    "raw": FLIGHT_COLUMNS_SQL.format(isodow=DUCKDB_ISODOW, joined="joined"),
    "curated": f"""
        SELECT FlightDate, Airline, Operating_Airline, Origin, Dest,
          CAST(Cancelled AS BIGINT) AS Cancelled, CAST(Diverted AS BIGINT) AS Diverted,
          CAST(NULL AS DOUBLE) AS DivAirportLandings,
          CRSDepTime, CAST(NULL AS INT) AS DepTime, CRSArrTime, CAST(NULL AS INT) AS ArrTime,
          DepDelayMinutes, ArrDelayMinutes,
          CAST(coalesce(DepDel15, 0) AS BIGINT) AS DepDel15, CAST(coalesce(ArrDel15, 0) AS BIGINT) AS ArrDel15,
          CAST(DepartureDelayGroups AS DOUBLE) AS DepartureDelayGroups,
          CAST(ArrivalDelayGroups AS DOUBLE) AS ArrivalDelayGroups,
          AirTime, CRSElapsedTime, ActualElapsedTime, Distance, DistanceGroup, Tail_Number,
          CAST(Flight_Number_Marketing_Airline AS BIGINT) AS Flight_Number_Marketing_Airline,
          CAST(Flight_Number_Operating_Airline AS BIGINT) AS Flight_Number_Operating_Airline,
          OriginCityName, OriginState, OriginStateName, DestCityName, DestState, DestStateName,
          DepTimeBlk, ArrTimeBlk,
          CAST(year(FlightDate) AS INT) AS Year, CAST(quarter(FlightDate) AS INT) AS Quarter,
          CAST(month(FlightDate) AS INT) AS Month, CAST(day(FlightDate) AS INT) AS DayOfMonth, DayOfWeek,
          row_number() OVER (ORDER BY {KEY}) AS seq
        FROM raw""",
    "dim_fecha": """
        SELECT row_number() OVER (ORDER BY FlightDate) AS dim_fecha_id, *
        FROM (SELECT DISTINCT ON (FlightDate) FlightDate, Year, Quarter, Month, DayOfMonth, DayOfWeek
              FROM curated WHERE FlightDate IS NOT NULL ORDER BY FlightDate, seq)""",
    "dim_hora": """
        SELECT row_number() OVER (ORDER BY hhmm) AS dim_hora_id, hhmm, TimeBlock,
          CAST(hhmm // 100 AS INT) AS Hora, CAST(hhmm % 100 AS INT) AS Minuto
        FROM (SELECT DISTINCT ON (hhmm) hhmm, TimeBlock FROM (
                SELECT CRSDepTime AS hhmm, DepTimeBlk AS TimeBlock, 0 AS src, seq FROM curated
                UNION ALL SELECT CRSArrTime, ArrTimeBlk, 1, seq FROM curated)
              WHERE hhmm IS NOT NULL ORDER BY hhmm, src, seq)""",
    "dim_aerolinea": """
        SELECT row_number() OVER (ORDER BY Airline) AS dim_aerolinea_id, Airline
        FROM (SELECT DISTINCT Airline FROM curated WHERE Airline IS NOT NULL)""",
    "dim_origen": """
        SELECT row_number() OVER (ORDER BY Origin, OriginCityName NULLS LAST, OriginState NULLS LAST,
                                  OriginStateName NULLS LAST) AS dim_origen_id, *
        FROM (SELECT DISTINCT Origin, OriginCityName, OriginState, OriginStateName
              FROM curated WHERE Origin IS NOT NULL)""",
    "dim_destino": """
        SELECT row_number() OVER (ORDER BY Dest, DestCityName NULLS LAST, DestState NULLS LAST,
                                  DestStateName NULLS LAST) AS dim_destino_id, *
        FROM (SELECT DISTINCT Dest, DestCityName, DestState, DestStateName FROM curated WHERE Dest IS NOT NULL)""",
    "dim_ruta": """
        SELECT row_number() OVER (ORDER BY Origin, Dest, DistanceGroup NULLS LAST) AS dim_ruta_id, *
        FROM (SELECT DISTINCT Origin, Dest, DistanceGroup FROM curated
              WHERE Origin IS NOT NULL AND Dest IS NOT NULL)""",
    "dim_avion": """
        SELECT row_number() OVER (ORDER BY Tail_Number) AS dim_avion_id, Tail_Number
        FROM (SELECT DISTINCT Tail_Number FROM curated WHERE Tail_Number IS NOT NULL)""",
    "dim_vuelo": """
        SELECT row_number() OVER (ORDER BY first_seq) AS dim_vuelo_id,
          Flight_Number_Marketing_Airline, Flight_Number_Operating_Airline
        FROM (SELECT Flight_Number_Marketing_Airline, Flight_Number_Operating_Airline, min(seq) AS first_seq
              FROM curated GROUP BY 1, 2)""",
    "fact": """
        SELECT c.seq AS fact_id, f.dim_fecha_id, h.dim_hora_id, ha.dim_hora_id AS dim_hora_arr_id, a.dim_avion_id,
          v.dim_vuelo_id, o.dim_origen_id, d.dim_destino_id, r.dim_ruta_id, l.dim_aerolinea_id,
          c.Distance, c.AirTime, c.CRSElapsedTime, c.ActualElapsedTime, c.DepDelayMinutes, c.ArrDelayMinutes,
          c.DepDel15, c.ArrDel15, c.Cancelled, c.Diverted, c.DepartureDelayGroups, c.ArrivalDelayGroups,
          c.Operating_Airline, c.DepTimeBlk, c.ArrTimeBlk
        FROM curated c
        LEFT JOIN dim_fecha f ON c.FlightDate = f.FlightDate
        LEFT JOIN dim_hora h ON c.CRSDepTime = h.hhmm
        LEFT JOIN dim_hora ha ON c.CRSArrTime = ha.hhmm
        LEFT JOIN dim_avion a ON c.Tail_Number = a.Tail_Number
        LEFT JOIN dim_vuelo v ON c.Flight_Number_Marketing_Airline = v.Flight_Number_Marketing_Airline
                             AND c.Flight_Number_Operating_Airline = v.Flight_Number_Operating_Airline
        LEFT JOIN (SELECT Origin, max(dim_origen_id) AS dim_origen_id FROM dim_origen GROUP BY 1) o
               ON c.Origin = o.Origin
        LEFT JOIN (SELECT Dest, max(dim_destino_id) AS dim_destino_id FROM dim_destino GROUP BY 1) d
               ON c.Dest = d.Dest
        LEFT JOIN (SELECT Origin, Dest, max(dim_ruta_id) AS dim_ruta_id FROM dim_ruta GROUP BY 1, 2) r
               ON c.Origin = r.Origin AND c.Dest = r.Dest
        LEFT JOIN dim_aerolinea l ON c.Airline = l.Airline""",
    "enriched": """
        SELECT x.*, f.FlightDate, f.Year, f.Quarter, f.Month, f.DayOfMonth, f.DayOfWeek,
          h.hhmm, h.Hora, h.Minuto, h.TimeBlock, l.Airline,
          o.Origin, o.OriginCityName, o.OriginState, o.OriginStateName,
          d.Dest, d.DestCityName, d.DestState, d.DestStateName,
          r.Origin AS Origin_ruta, r.Dest AS Dest_ruta, r.DistanceGroup, a.Tail_Number,
          v.Flight_Number_Marketing_Airline, v.Flight_Number_Operating_Airline
        FROM fact x
        LEFT JOIN dim_fecha f USING (dim_fecha_id)
        LEFT JOIN dim_hora h USING (dim_hora_id)
        LEFT JOIN dim_aerolinea l USING (dim_aerolinea_id)
        LEFT JOIN dim_origen o USING (dim_origen_id)
        LEFT JOIN dim_destino d USING (dim_destino_id)
        LEFT JOIN dim_ruta r USING (dim_ruta_id)
        LEFT JOIN dim_avion a USING (dim_avion_id)
        LEFT JOIN dim_vuelo v USING (dim_vuelo_id)""",
    "star_inner": """
        SELECT h.hhmm AS CRSDepTime, ha.hhmm AS CRSArrTime, x.Distance, f.DayOfWeek, f.Month, f.Year,
          l.Airline, o.Origin, d.Dest, x.DepTimeBlk, x.ArrTimeBlk, x.DepDel15
        FROM fact x
        JOIN dim_hora h ON x.dim_hora_id = h.dim_hora_id
        JOIN dim_hora ha ON x.dim_hora_arr_id = ha.dim_hora_id
        JOIN dim_fecha f ON x.dim_fecha_id = f.dim_fecha_id
        JOIN dim_aerolinea l ON x.dim_aerolinea_id = l.dim_aerolinea_id
        JOIN dim_origen o ON x.dim_origen_id = o.dim_origen_id
        JOIN dim_destino d ON x.dim_destino_id = d.dim_destino_id""",
    "ml": """
        SELECT *, CAST(CRSDepTime // 100 AS INT) AS DepHour, CAST(CRSArrTime // 100 AS INT) AS ArrHour,
          CAST(DepDel15 AS DOUBLE) AS label
        FROM star_inner WHERE Year IS NOT NULL AND DayOfWeek IS NOT NULL""",
    "train": "SELECT * FROM ml WHERE Year < (SELECT max(Year) FROM ml)",
    "valid": "SELECT * FROM ml WHERE Year = (SELECT max(Year) FROM ml)",
}


def _top(source: str, column: str, n: int) -> str:
    return (
        f"SELECT {column} FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY 1 ORDER BY n DESC, {column} LIMIT {n})"
    )


KEPT = (("Airline", 10), ("Origin", 20), ("Dest", 20), ("DepTimeBlk", 12), ("ArrTimeBlk", 12))


def _reduced(rows: str, source: str) -> str:
    """Columns of ``rows`` with categories outside the top of ``source`` replaced."""
    replaced = ", ".join(
        f"CASE WHEN {c} IN ({_top(source, c, n)}) THEN {c} ELSE 'OTHER' END AS {c}" for c, n in KEPT
    )
    return f"SELECT * REPLACE ({replaced}) FROM {rows}"


STEPS["train_reduced"] = _reduced("train", "train")
STEPS["valid_reduced"] = _reduced("valid", "train")
STEPS["ml_curated"] = """
    SELECT CRSDepTime, CRSArrTime, Distance, DayOfWeek, Month, Airline, Origin, Dest, DepTimeBlk, ArrTimeBlk,
      CAST(CRSDepTime // 100 AS INT) AS DepHour, CAST(CRSArrTime // 100 AS INT) AS ArrHour,
      CAST(DepDel15 AS DOUBLE) AS label
    FROM curated
    WHERE CRSDepTime IS NOT NULL AND CRSArrTime IS NOT NULL AND Distance IS NOT NULL
      AND DayOfWeek IS NOT NULL AND Month IS NOT NULL"""
# A prediction by a rule on columns, so that what follows from predictions can be checked.
STEPS["ruled"] = """
    SELECT *, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
    FROM (SELECT *, ((DepHour * 7 + DayOfWeek * 3 + Month) % 10) / 10.0::DOUBLE AS score FROM valid)"""
STEPS["all_reduced"] = _reduced("ml_curated", "ml_curated")


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql))
    return [name for name in STEPS if name in words]


def _sql(query: str) -> str:
    """The query with every step it reads, directly or not, as a CTE."""
    needed: set[str] = set()
    todo = _uses(query)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(_uses(STEPS[name]))
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({STEPS[name]})" for name in STEPS if name in needed)
    return f"WITH {ctes}\n{query}" if ctes else query


FACT_COLUMNS = """fact_id, dim_fecha_id, dim_hora_id, dim_hora_arr_id, dim_avion_id, dim_vuelo_id, dim_origen_id,
  dim_destino_id, dim_ruta_id, dim_aerolinea_id, Distance, AirTime, CRSElapsedTime, ActualElapsedTime,
  DepDelayMinutes, ArrDelayMinutes, DepDel15, ArrDel15, Cancelled, Diverted, DepartureDelayGroups,
  ArrivalDelayGroups, Operating_Airline, DepTimeBlk, ArrTimeBlk"""


def _kpis(where: str = "TRUE") -> str:
    return f"""
    SELECT count(*) AS total_flights,
      coalesce(avg(DepDelayMinutes), 0) AS retraso_salida_promedio,
      coalesce(avg(ArrDelayMinutes), 0) AS retraso_llegada_promedio,
      coalesce(avg(CASE WHEN ArrDelayMinutes <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 0) AS otp,
      coalesce(avg(Cancelled::DOUBLE) * 100, 0) AS cancelaciones_pct,
      coalesce(avg(CASE WHEN ArrDelayMinutes > 15 OR Cancelled = 1 OR Diverted = 1
                        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 0) AS affected_pct,
      coalesce(sum(DepDelayMinutes), 0) / 60 AS retraso_salida_acumulado_horas,
      coalesce(sum(ArrDelayMinutes), 0) / 60 AS retraso_llegada_acumulado_horas
    FROM enriched WHERE {where}"""


def _airline_delay(where: str = "TRUE") -> str:
    return f"""
    SELECT coalesce(Airline, 'Sin aerolínea') AS aerolinea, avg(ArrDelayMinutes) AS retraso_llegada_promedio
    FROM enriched WHERE {where} GROUP BY 1"""


def _routes(limit: int, where: str = "TRUE") -> str:
    return f"""
    SELECT coalesce(Origin, 'Sin origen') || ' → ' || coalesce(Dest, 'Sin destino') AS ruta,
      coalesce(sum(DepDelayMinutes), 0) AS retraso_salida_minutos,
      avg(ArrDelayMinutes) AS retraso_llegada_promedio,
      avg(Cancelled::DOUBLE) * 100 AS cancelaciones_pct,
      count(*) AS total_flights,
      coalesce(sum(DepDelayMinutes), 0) / 60 AS retraso_salida_horas
    FROM enriched WHERE {where} GROUP BY 1 ORDER BY retraso_salida_minutos DESC, ruta LIMIT {limit}"""


# Raw values spoilt by a rule on keys, as text.
def _dirty(column: str, kind: str) -> str:
    return f"""CASE (l_orderkey + l_partkey) % 23 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
      WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN {'NULL' if kind == 'DATE' else '12'}
      ELSE CAST({column} AS {kind}) END"""


CALENDAR_WHERE = "Year = 1995 AND Month >= 3 AND Month <= 9"
SEVERAL_WHERE = "Year = 1996 AND Month >= 2 AND dim_aerolinea_id = 5 AND Cancelled = 0"

RESOLVE_CASES: dict[str, tuple[str, list[str], list[str]]] = {
    # dimension: id column, match columns, values
    "dim_aerolinea": ("dim_aerolinea_id", ["Airline"],
                      ["Brand#11", " brand#23 ", "Brand#55 - Línea", "brand", "7", "7.9", "9999", "zzz", "Todas", "   "]),
    "dim_origen": ("dim_origen_id", ["Origin", "OriginCityName", "OriginState", "OriginStateName"],
                   ["N3", "n1 - algo", "R2", "AMÉRICA", "BRAZIL", "europe", "12", "77.5", "xyz", "Todos"]),
    "dim_ruta": ("dim_ruta_id", ["Origin", "Dest", "DistanceGroup"], ["N10", "10", "N4 - N7", "1e9"]),
    "dim_hora": ("dim_hora_id", ["hhmm", "Hora", "TimeBlock"], ["1530", "0500-0559", "23", "9 h", "noche"]),
}


def _norm(value: str) -> str:
    return f"regexp_replace(trim(translate(lower({value}), 'áéíóúäëïöüñ', 'aeiouaeioun')), '\\s+', ' ', 'g')"


def _resolve(dim: str) -> str:
    id_col, columns, values = RESOLVE_CASES[dim]
    rows = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    blank = "v.value IN ('', 'Todos', 'Todas', 'All')"
    number = f"CASE WHEN {blank} THEN NULL ELSE CAST(trunc(TRY_CAST(trim(v.value) AS DOUBLE)) AS BIGINT) END"
    whens = [f"WHEN {id_col} = {number} THEN 0"]
    for i, c in enumerate(columns):
        text, wanted = _norm(f"CAST({c} AS VARCHAR)"), _norm("v.value")
        whens.append(f"WHEN {text} = {wanted} THEN {2 * i + 1}")
        whens.append(f"WHEN {text} <> '' AND (contains({wanted}, {text}) OR contains({text}, {wanted})) THEN {2 * i + 2}")
    return f"""
    SELECT '{dim}' AS dim, value, CAST(coalesce(best, number) AS BIGINT) AS dim_id, best IS NOT NULL AS matched
    FROM (SELECT v.value, any_value({number}) AS number,
            arg_min({id_col}, rank * 1000000 + {id_col}) FILTER (rank IS NOT NULL) AS best
          FROM (VALUES {rows}) v(value)
          LEFT JOIN LATERAL (SELECT {id_col}, CASE WHEN {blank} THEN NULL ELSE CASE {' '.join(whens)} END END AS rank
                             FROM {dim}) ON TRUE
          GROUP BY v.value)"""


OPTIONS = (
    ("airlines", "dim_aerolinea", ["Airline"]),
    ("origins", "dim_origen", ["Origin", "OriginCityName", "OriginStateName"]),
    ("destinations", "dim_destino", ["Dest", "DestCityName", "DestStateName"]),
    ("routes", "dim_ruta", ["Origin", "Dest", "DistanceGroup"]),
    ("hours", "dim_hora", ["TimeBlock", "Hora", "hhmm"]),
)


def _label(columns: list[str]) -> str:
    """Parts joined by " - ", each only if no earlier part is equal."""
    parts = [f"trim(CAST({c} AS VARCHAR))" for c in columns]
    kept = [
        "CASE WHEN " + " AND ".join([f"{p} <> ''"] + [f"{p} IS DISTINCT FROM {q}" for q in parts[:i]]) + f" THEN {p} END"
        for i, p in enumerate(parts)
    ]
    return f"concat_ws(' - ', {', '.join(kept)})"


def _options(where: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS list, {dim}_id AS id, {_label(columns)} AS label FROM {dim} "
        f"WHERE {dim}_id IN (SELECT {dim}_id FROM enriched WHERE {where})"
        for name, dim, columns in OPTIONS
    )


DIM_FILTERS = (
    ("airline", "dim_aerolinea_id", 3), ("origin", "dim_origen_id", 4), ("dest", "dim_destino_id", 6),
    ("route", "dim_ruta_id", 9), ("hour", "dim_hora_id", 100), ("aircraft", "dim_avion_id", 5),
    ("flight", "dim_vuelo_id", 20),
)

PARSE_WORDS = (
    "", "Todos", "All", "12.7", "sí", " SI ", "no", "Cancelado", "no  cancelado", "Puntual", "on time",
    "1", "0", "-3.9", "abc", "1e2", "retrasado",
)
PARSED = {  # word -> int, float, bool
    "12.7": ("12", "12.7", "NULL"), "sí": ("NULL", "NULL", "TRUE"), " SI ": ("NULL", "NULL", "TRUE"),
    "no": ("NULL", "NULL", "FALSE"), "Cancelado": ("NULL", "NULL", "TRUE"),
    "no  cancelado": ("NULL", "NULL", "FALSE"), "Puntual": ("NULL", "NULL", "FALSE"),
    "on time": ("NULL", "NULL", "FALSE"), "1": ("1", "1", "TRUE"), "0": ("0", "0", "FALSE"),
    "-3.9": ("-3", "-3.9", "NULL"), "1e2": ("100", "100", "NULL"), "retrasado": ("NULL", "NULL", "TRUE"),
}


def _parse_case(position: int, kind: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {PARSED[word][position]}" for i, word in enumerate(PARSE_WORDS) if word in PARSED
    )
    return f"CAST(CASE (l_orderkey + l_linenumber) % {len(PARSE_WORDS) + 1} {whens} END AS {kind})"


CANONICAL_NULLS = {"DivAirportLandings": "DOUBLE", "DepTime": "INT", "ArrTime": "INT", "Year": "INT",
                   "Quarter": "INT", "Month": "INT", "DayofMonth": "INT"}


def _string_index(source: str, column: str) -> str:
    """Rank by frequency, ties by name."""
    return (f"SELECT {column} AS value, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS idx "
            f"FROM {source} GROUP BY {column}")


def _indexed(rows: str, source: str, columns: str) -> str:
    joins = " ".join(f"LEFT JOIN ({_string_index(source, c)}) i{k} ON r.{c} = i{k}.value" for k, (c, _) in enumerate(KEPT))
    indexes = ", ".join(
        f"coalesce(i{k}.idx, (SELECT count(DISTINCT {c}) FROM {source})) AS {c}_idx" for k, (c, _) in enumerate(KEPT)
    )
    return f"SELECT {columns}, {indexes} FROM {rows} r {joins}"


QUERIES: dict[str, str] = {
    # scans, sources, sinks
    "ingest_union": f"""
        SELECT {KEY}, CASE WHEN l_linenumber <= 3 THEN FlightDate END AS FlightDate, Airline, Origin, Dest,
          CASE WHEN l_linenumber <= 3 THEN CRSDepTime END AS CRSDepTime,
          CASE WHEN l_linenumber > 3 THEN DepDelayMinutes END AS DepDelayMinutes, Distance
        FROM raw""",
    "landing_roundtrip": "SELECT * FROM raw",
    "curated_partitions": """
        SELECT Year, Month, count(*) AS n_rows, count(Airline) AS n_airline, sum(DepDelayMinutes) AS dep_delay,
          min(FlightDate) AS first_date, max(FlightDate) AS last_date
        FROM curated WHERE Year IS NOT NULL AND Month IS NOT NULL GROUP BY 1, 2""",
    "star_row_counts": "\nUNION ALL ".join(
        f"SELECT '{'fact_flights' if t == 'fact' else t}' AS table_name, count(*) AS n_rows FROM {t}"
        for t in ("dim_fecha", "dim_hora", "dim_aerolinea", "dim_origen", "dim_destino", "dim_ruta", "dim_avion",
                  "dim_vuelo", "fact")
    ),
    "orc_roundtrip": f"SELECT {FACT_COLUMNS} FROM fact",
    "scan_projection": "SELECT dim_origen_id, Origin, OriginStateName FROM dim_origen",
    "csv_export_roundtrip": "SELECT * FROM dim_fecha",
    "csv_sample": """
        SELECT FlightDate, Airline, Origin, Dest, CRSDepTime, DepDelayMinutes, Cancelled, Tail_Number, Year, Month
        FROM curated WHERE seq <= 10000""",
    # projections, cleaning, scalar functions
    "canonical_map": "SELECT * EXCLUDE (" + KEY + "), "
        + ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in CANONICAL_NULLS.items()) + " FROM raw",
    "clean_dates": f"SELECT {KEY}, {_dirty('FlightDate', 'DATE')} AS FlightDate FROM raw",
    "clean_numeric": f"SELECT {KEY}, " + ", ".join(
        f"{_dirty(c, 'DOUBLE')} AS {c}" for c in
        ("Distance", "AirTime", "CRSElapsedTime", "ActualElapsedTime", "DepDelayMinutes", "ArrDelayMinutes")
    ) + " FROM raw",
    "clean_flags": f"SELECT {KEY}, " + ", ".join(
        f"coalesce({_dirty(c, 'BIGINT')}, 0) AS {c}" for c in ("Cancelled", "Diverted", "DepDel15", "ArrDel15")
    ) + " FROM raw",
    "clean_ints": f"SELECT {KEY}, " + ", ".join(
        f"{_dirty(c, 'INT')} AS {c}" for c in ("DayOfWeek", "CRSDepTime", "CRSArrTime", "DistanceGroup")
    ) + f", {_dirty('Flight_Number_Operating_Airline', 'BIGINT')} AS Flight_Number_Operating_Airline FROM raw",
    "calendar_fill": f"""
        SELECT {KEY}, coalesce(CASE WHEN l_linenumber = 1 THEN 2001 END, year(FlightDate))::INT AS Year,
          quarter(FlightDate)::INT AS Quarter,
          coalesce(CASE WHEN l_linenumber = 2 THEN 13 END, month(FlightDate))::INT AS Month,
          day(FlightDate)::INT AS DayOfMonth, CASE WHEN l_linenumber <> 3 THEN DayOfWeek END AS DayOfWeek
        FROM raw""",
    "hhmm_parts": f"""
        SELECT {KEY}, hhmm, CAST(hhmm // 100 AS INT) AS hour, CAST(hhmm % 100 AS INT) AS minute
        FROM (SELECT *, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 2400 WHEN 3 THEN CRSDepTime % 60
                        ELSE CRSDepTime END AS hhmm FROM raw)""",
    "hour_buckets": f"""
        SELECT {KEY}, CAST(CRSDepTime // 100 AS INT) AS DepHour, CAST(CRSArrTime // 100 AS INT) AS ArrHour FROM raw""",
    "label_fallback": """
        SELECT coalesce(Airline, 'Sin aerolínea') AS airline_label, 'Sin dato' AS missing_label,
          0.0::DOUBLE AS missing_number, count(*) AS n FROM raw GROUP BY 1""",
    "regex_columns": """
        SELECT Airline AS airline, Origin AS origin, count(*) AS n, sum(DepDelayMinutes) AS dep_delay
        FROM raw GROUP BY 1, 2""",
    "norm_text": f"""
        SELECT {_norm("concat('  ÁÉ', coalesce(Airline, ''), '   Ñandú ÜBER' || chr(9), OriginCityName, ' ')")} AS text,
          coalesce({_norm("Airline")}, '') AS airline, count(*) AS n
        FROM raw GROUP BY 1, 2""",
    "parse_values": f"""
        SELECT {KEY}, {_parse_case(0, 'BIGINT')} AS as_int, {_parse_case(1, 'DOUBLE')} AS as_float,
          {_parse_case(2, 'BOOLEAN')} AS as_bool FROM raw""",
    # filters
    "filter_calendar": f"SELECT {FACT_COLUMNS} FROM enriched WHERE {CALENDAR_WHERE}",
    "filter_dimensions": "\nUNION ALL ".join(
        f"SELECT '{name}' AS filter, fact_id, DepDelayMinutes FROM enriched WHERE {key} = {value}"
        for name, key, value in DIM_FILTERS
    ),
    "filter_flags": """
        SELECT 'cancelled' AS filter, fact_id FROM enriched WHERE Cancelled = 1
        UNION ALL SELECT 'diverted', fact_id FROM enriched WHERE Diverted = 1
        UNION ALL SELECT 'flown', fact_id FROM enriched WHERE Cancelled = 0 AND Diverted = 0""",
    "filter_delayed15": """
        SELECT TRUE AS delayed, fact_id, DepDelayMinutes FROM enriched WHERE DepDel15 = 1
        UNION ALL SELECT FALSE, fact_id, DepDelayMinutes FROM enriched WHERE DepDel15 = 0""",
    "filter_delayed15_minutes": """
        SELECT TRUE AS delayed, fact_id, DepDelayMinutes FROM enriched WHERE coalesce(DepDelayMinutes, 0) > 15
        UNION ALL SELECT FALSE, fact_id, DepDelayMinutes FROM enriched WHERE coalesce(DepDelayMinutes, 0) <= 15""",
    "filtered_fact": f"""
        SELECT {FACT_COLUMNS}, Year, Month, Airline, OriginCityName, Dest FROM enriched WHERE {SEVERAL_WHERE}""",
    "filter_aliases": """
        SELECT fact_id, Year, Month, Airline FROM enriched
        WHERE Year = 1996 AND Month >= 2 AND Airline = 'Brand#23' AND Dest = 'N7' AND Cancelled = 0""",
    "resolve_dim_values": "\nUNION ALL ".join(_resolve(dim) for dim in RESOLVE_CASES),
    "filter_options": _options(CALENDAR_WHERE),
    "temporal_split": """
        SELECT CASE WHEN Year = (SELECT max(Year) FROM ml) THEN 'validation' ELSE 'train' END AS split, Year,
          count(*) AS n, sum(label) AS n_delayed FROM ml GROUP BY 1, 2""",
    # dimensions and keys
    "dim_date": "SELECT * FROM dim_fecha",
    "dim_hour": "SELECT * FROM dim_hora",
    "dim_airline": "SELECT * FROM dim_aerolinea",
    "dim_origin": "SELECT * FROM dim_origen",
    "dim_dest": "SELECT * FROM dim_destino",
    "dim_route": "SELECT * FROM dim_ruta",
    "dim_aircraft": "SELECT * FROM dim_avion",
    "dim_flight_no": "SELECT * FROM dim_vuelo",
    # joins
    "fk_lookup": """
        SELECT fact_id, dim_fecha_id, dim_aerolinea_id, dim_origen_id, dim_destino_id, dim_avion_id FROM fact""",
    "fk_lookup_composite": "SELECT fact_id, dim_ruta_id, dim_vuelo_id FROM fact",
    "fk_lookup_roles": "SELECT fact_id, dim_hora_id, dim_hora_arr_id FROM fact",
    "fact_flights": f"SELECT {FACT_COLUMNS} FROM fact",
    "enriched_fact": "SELECT * FROM enriched",
    "star_join_inner": "SELECT * FROM star_inner",
    "topn_other": """
        SELECT 'train' AS split, * FROM train_reduced UNION ALL SELECT 'validation', * FROM valid_reduced""",
    # analytic queries
    "kpi_summary": _kpis(),
    "kpi_summary_filtered": _kpis(SEVERAL_WHERE),
    "kpi_summary_empty": _kpis("Year = 1900"),
    "kpi_status": f"""
        SELECT *, CASE WHEN round(otp, 2) >= 80 THEN 'good' ELSE 'warn' END AS otp_status,
          CASE WHEN round(cancelaciones_pct, 2) > 5 THEN 'bad' END AS cancelaciones_status,
          CASE WHEN round(affected_pct, 2) > 25 THEN 'bad' ELSE 'warn' END AS affected_status
        FROM ({_kpis()})""",
    "otp_departure": """
        SELECT count(*) AS n_flights, avg(1 - DepDel15) AS otp_departure, avg(DepDelayMinutes) AS avg_dep_delay,
          avg(DepDel15) AS pct_delayed15 FROM fact""",
    "otp_departure_long": """
        SELECT 'n_flights' AS metric, count(*)::DOUBLE AS value FROM fact
        UNION ALL SELECT 'otp_departure', avg(1 - DepDel15) FROM fact
        UNION ALL SELECT 'avg_dep_delay', avg(DepDelayMinutes) FROM fact
        UNION ALL SELECT 'pct_delayed15', avg(DepDel15) FROM fact""",
    "airline_arr_delay": _airline_delay(),
    "airline_arr_delay_filtered": _airline_delay(CALENDAR_WHERE),
    "critical_airports": """
        SELECT coalesce(Origin, 'Sin origen') AS origen, coalesce(OriginCityName, '') AS ciudad_origen,
          coalesce(sum(DepDelayMinutes), 0) AS retraso_salida_minutos,
          coalesce(sum(DepDelayMinutes), 0) / 60 AS retraso_salida_horas
        FROM enriched GROUP BY 1, 2 ORDER BY retraso_salida_minutos DESC, origen, ciudad_origen LIMIT 15""",
    "airline_cancellations": """
        SELECT coalesce(Airline, 'Sin aerolínea') AS aerolinea, avg(Cancelled::DOUBLE) * 100 AS cancelaciones_pct
        FROM enriched GROUP BY 1""",
    "monthly_delay": f"""
        SELECT {MONTH_CASE.format(m='Month')} AS mes, avg(DepDelayMinutes) AS retraso_salida_promedio,
          avg(ArrDelayMinutes) AS retraso_llegada_promedio, count(*) AS total_flights
        FROM enriched WHERE Month IS NOT NULL GROUP BY Month""",
    "critical_routes": _routes(15),
    "critical_routes_filtered": _routes(7, CALENDAR_WHERE),
    "status_distribution": """
        SELECT categoria, flights, flights / sum(flights) OVER ()::DOUBLE * 100 AS porcentaje FROM (
          SELECT 'Puntuales' AS categoria, count(*) AS flights FROM fact
            WHERE ArrDelayMinutes <= 15 AND Cancelled <> 1 AND Diverted <> 1
          UNION ALL SELECT 'Retrasados > 15 min', count(*) FROM fact
            WHERE ArrDelayMinutes > 15 AND Cancelled <> 1 AND Diverted <> 1
          UNION ALL SELECT 'Cancelados', count(*) FROM fact WHERE Cancelled = 1
          UNION ALL SELECT 'Desviados', count(*) FROM fact WHERE Diverted = 1)""",
    "airline_dep_delay": """
        SELECT dim_aerolinea_id, avg(DepDelayMinutes) AS avg_dep_delay FROM fact
        WHERE dim_aerolinea_id IS NOT NULL GROUP BY 1""",
    "year_options": "SELECT DISTINCT Year AS year FROM dim_fecha WHERE Year IS NOT NULL",
    "month_options": f"""
        SELECT DISTINCT Month AS month, {MONTH_CASE.format(m='Month')} AS label FROM dim_fecha WHERE Month IS NOT NULL""",
    # limits
    "topn_clamp": "\nUNION ALL ".join(
        f"SELECT '{asked}' AS asked, count(*) AS n_rows FROM ({_routes(limit)})"
        for asked, limit in (("0", 15), ("-3", 1), ("7", 7), ("x", 15), ("999", 50), ("none", 15))
    ),
    "flight_table": """
        SELECT Year, Month, FlightDate, Airline, Origin, OriginCityName, Dest, DestCityName, DepDelayMinutes,
          ArrDelayMinutes, AirTime, Distance, Cancelled, Diverted, Tail_Number, Flight_Number_Marketing_Airline,
          Flight_Number_Operating_Airline
        FROM enriched WHERE Year = 1995 ORDER BY fact_id LIMIT 700""",
    # tables for models
    "ml_frame": "SELECT * FROM ml",
    "class_distribution": """
        SELECT label, count(*) AS count, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM train GROUP BY 1""",
    "top_categories": "\nUNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS name, {c} AS value, count(*) AS count FROM train WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count DESC, value LIMIT {n})" for c, n in KEPT
    ),
    "topn_other_all": _reduced("ml_curated", "ml_curated"),
    # the whole table, as long as it has no more rows than the sample
    "ml_sample": "SELECT * FROM ml_curated",
    "ml_sample_bounded": """
        SELECT least(count(*), 2000)::BIGINT AS n_rows, least(count(*), 2000)::BIGINT AS n_keys, true AS fair FROM ml_curated""",
    "ingest_order": f"""
        SELECT row_number() OVER (ORDER BY CASE WHEN l_linenumber = 2 THEN 'a' WHEN l_linenumber IN (1, 3) THEN 'b'
          WHEN l_linenumber = 4 THEN 'c' ELSE 'd' END, {KEY}) AS fact_id, {KEY} FROM raw""",
    "ingest_report": """
        SELECT name, CASE name WHEN 'a.csv' THEN count_if(l_linenumber = 2) WHEN 'b.parquet' THEN count_if(l_linenumber IN (1, 3))
          WHEN 'c.csv' THEN count_if(l_linenumber = 4) WHEN 'd.parquet' THEN count_if(l_linenumber > 4) ELSE 0 END::BIGINT AS n_rows,
          name = 'broken.parquet' AS skipped
        FROM raw CROSS JOIN (VALUES ('a.csv'), ('b.parquet'), ('broken.parquet'), ('c.csv'), ('d.parquet')) f(name) GROUP BY name""",
    "ingest_refusals": """
        WITH notes AS (SELECT c_custkey AS k, c_name || chr(10) || '"' || c_mktsegment || '", ' || c_custkey AS note FROM customer)
        SELECT 'breaks' AS name, count(*) AS n_rows, false AS skipped, NULL AS reason, sum(k)::BIGINT AS keys, count(*) AS n_breaks,
          sum(length(note))::BIGINT AS note_chars, count(*) AS n_balances FROM notes
        UNION ALL SELECT 'short', count(*), false, NULL, sum(k)::BIGINT, 0, count(*), 0 FROM notes
        UNION ALL SELECT 'header', 0, false, NULL, NULL, NULL, NULL, NULL
        UNION ALL SELECT name, 0, true, reason, NULL, NULL, NULL, NULL FROM (VALUES
          ('ragged', 'a record has more fields than the header'), ('quoted_ragged', 'a record has more fields than the header'),
          ('unended', 'a quoted value has no end'), ('latin', 'not UTF-8')) refused(name, reason)""",
    "first_row_per_key": """
        SELECT dim_origen_id, Origin, OriginCityName, OriginState, OriginStateName FROM dim_origen""",
    "confusion_matrix": """
        SELECT label, prediction, count(*) AS count FROM ruled GROUP BY 1, 2""",
    "classification_report": """
        SELECT * FROM (WITH counts AS (
          SELECT c.class, count_if(label = c.class) AS support, count_if(prediction = c.class) AS predicted,
            count_if(label = c.class AND prediction = c.class) AS hits
          FROM ruled CROSS JOIN (SELECT DISTINCT label AS class FROM ruled) c GROUP BY 1),
        ratios AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM counts),
        scores AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM ratios)
        SELECT class::INT::VARCHAR AS class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM scores
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9),
          round(sum(hits) / sum(support), 9), sum(support)::BIGINT FROM scores
        UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(support)::BIGINT FROM scores
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
          round(sum(f * support) / sum(support), 9), sum(support)::BIGINT FROM scores)""",
    "evaluate_rule": """
        SELECT * FROM (WITH ranked AS (
          SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS r FROM ruled),
        n AS (SELECT count_if(label = 1)::DOUBLE AS pos, count_if(label = 0)::DOUBLE AS neg FROM ruled),
        counts AS (
          SELECT c.class, count_if(label = c.class) AS support, count_if(prediction = c.class) AS predicted,
            count_if(label = c.class AND prediction = c.class) AS hits
          FROM ruled CROSS JOIN (SELECT DISTINCT label AS class FROM ruled) c GROUP BY 1)
        SELECT 'auc_roc' AS metric, round((sum(CASE WHEN label = 1 THEN r END) - any_value(pos) * (any_value(pos) + 1) / 2)
          / (any_value(pos) * any_value(neg)), 9) AS value FROM ranked CROSS JOIN n
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 9) FROM counts
        UNION ALL SELECT 'f1', round(sum(coalesce(2 * hits / nullif(predicted + support, 0), 0) * support) / sum(support), 9) FROM counts)""",
    "roc_area": """
        SELECT * FROM (WITH fine AS (SELECT label, (Distance * 31 + CRSDepTime * 7 + DayOfWeek) % 100003 AS score FROM ruled),
        ranked AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS r FROM fine),
        n AS (SELECT count_if(label = 1)::DOUBLE AS pos, count_if(label = 0)::DOUBLE AS neg FROM fine)
        SELECT 'auc_roc' AS metric, round((sum(CASE WHEN label = 1 THEN r END) - any_value(pos) * (any_value(pos) + 1) / 2)
          / (any_value(pos) * any_value(neg)), 9) AS value FROM ranked CROSS JOIN n)""",
    "score_labels": """
        SELECT CRSDepTime, CRSArrTime, Distance, DayOfWeek, Month, prediction, round(score * 100, 9) AS delay_pct,
          round((1 - score) * 100, 9) AS on_time_pct, CASE prediction WHEN 1 THEN 'DEMORADO' ELSE 'A TIEMPO' END AS verdict
        FROM ruled""",
    "model_roundtrip": "SELECT count(*) AS n_rows, 0::BIGINT AS n_differing FROM valid",
    "batch_score": """
        SELECT count(*) AS n_rows, count(*) AS n_hour_filled, count_if(DayOfWeek >= 6) AS n_block_filled, count(*) AS n_scored
        FROM valid""",
    "one_hot": "SELECT label, concat_ws(',', Distance::INT, DayOfWeek, Month, DepHour, ArrHour, " + ", ".join(
        f"array_to_string(list_transform(range((SELECT count(DISTINCT {c}) FROM all_reduced) - 1), "
        f"lambda i: CASE WHEN i = {c}_idx THEN 1 ELSE 0 END), ',')" for c, _ in KEPT
    ) + ") AS features FROM (" + _indexed(
        "all_reduced", "all_reduced", "r.label, r.Distance, r.DayOfWeek, r.Month, r.DepHour, r.ArrHour"
    ) + ")",
    "string_index": _indexed("valid_reduced", "train_reduced", ", ".join(f"r.{c}" for c, _ in KEPT)),
    "feature_vectors": "SELECT * FROM (" + _indexed(
        "valid_reduced", "train_reduced",
        "r.Distance, r.DayOfWeek::DOUBLE AS DayOfWeek, r.Month::DOUBLE AS Month, r.DepHour::DOUBLE AS DepHour, "
        "r.ArrHour::DOUBLE AS ArrHour, r.label",
    ) + ")",
    "stratified_split": """
        SELECT split, label, CASE split WHEN 'test' THEN round(n * 0.2) ELSE n - round(n * 0.2) END::BIGINT AS n
        FROM (SELECT label, count(*) AS n FROM ml_curated GROUP BY 1) CROSS JOIN (VALUES ('train'), ('test')) s(split)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(query) for name, query in QUERIES.items()}
