"""Every operator as ``(spark, sf_dir) -> DataFrame`` over the test tables.

The landing table and the star are built once per application and data
directory, as the jobs of a deployment would do, and then read by the queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..binding import ROW_KEY, dirty_flights, flights_raw
from ..functions import clean, text
from ..ml import categories, evaluate, frame, score, search, train as training
from ..operators import dims as dim_builders
from ..operators.canonical import canonical, curate, fill_calendar, typed
from ..operators.enrich import column_sources, enriched
from ..operators.fact import LOOKUPS, build_fact, look_up_date, look_up_key
from ..operators.filters import MATCH_COLUMNS, Filters, filtered_fact, pick_aliases
from ..operators.ids import number_stored_rows
from ..operators.resolve import resolve_values
from ..plans import kpis, options, rankings, tables
from ..plans.rollup import top_n
from ..schema import FACT, FACT_COLUMNS, FILE_PLACE, ROW_SEQ, key_of
from ..sources import ingest as ingestion, layers, sizes
from ..sources.datamart import Star, build_star, read_first_rows, read_table
from ..workspace import drop_table, fresh_path, shuffles_dropped
from .oracle import DIM_FILTERS, PARSE_WORDS, RESOLVE_CASES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# (application, data directory) -> what has been built there
_landings: dict[tuple[str, str], DataFrame] = {}
_stars: dict[tuple[str, str], tuple[Star, str]] = {}
_models: dict[tuple[str, ...], dict[str, PipelineModel]] = {}

CALENDAR_REQUEST = {"anio": 1995, "mes_inicio": 3, "mes_fin": 9}
SEVERAL_REQUEST = {"anio": "1996", "mes_inicio": 2, "dim_aerolinea_id": 5, "cancelado": "no"}
ALIAS_REQUEST = {
    "anio": "", "year": "1996", "carrier": " brand#23 ", "aerolinea": "Todas", "mes_desde": "2.0",
    "dest": "N7", "is_cancelled": "No cancelado", "diverted": "quizás",
}


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landings:
        _landings[key] = layers.land(flights_raw(spark, sf_dir, in_order=True), fresh_path(spark, "landing"))
    return _landings[key]


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw columns of the landing table."""
    return landing(spark, sf_dir).drop(ROW_SEQ)


def stored_star(spark: SparkSession, sf_dir: str) -> tuple[Star, str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stars:
        root = fresh_path(spark, "datamart")
        _stars[key] = build_star(landing(spark, sf_dir), root), root
    return _stars[key]


def star(spark: SparkSession, sf_dir: str) -> Star:
    return stored_star(spark, sf_dir)[0]


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate(landing(spark, sf_dir))


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def on_star(name: str, plan: Callable[[Star], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(star(spark, sf_dir))


# --- scans, sources, sinks ---


@query("ingest_union")
def _(spark, sf_dir):
    raw, folder = raw_flights(spark, sf_dir), fresh_path(spark, "inbox")
    both = [*ROW_KEY, "Airline", "Origin", "Dest", "Distance"]
    layers.write_csv(raw.where("l_linenumber <= 3").select(*both, "FlightDate", "CRSDepTime"), f"{folder}/a.CSV")
    raw.where("l_linenumber > 3").select("DepDelayMinutes", *both).write.parquet(f"{folder}/b.parquet")
    raw.select(F.lit("not a parquet file")).limit(1).write.text(f"{folder}/broken.parquet")
    united = ingestion.ingest(spark, folder)
    cleaned = curate(united.withColumn(ROW_SEQ, F.monotonically_increasing_id()))
    keys = {c: ("double" if c in ("l_quantity", "l_extendedprice") else "bigint") for c in ROW_KEY}
    return united.select(
        *[F.col(c).try_cast(kind).alias(c) for c, kind in keys.items()],
        clean.calendar_date(F.col("FlightDate"), united.schema["FlightDate"].dataType).alias("FlightDate"),
        "Airline", "Origin", "Dest",
        *[
            F.col(c).try_cast(cleaned.schema[c].dataType).alias(c)
            for c in ("CRSDepTime", "DepDelayMinutes", "Distance")
        ],
    )


def _inbox(spark, sf_dir):
    """Files of unequal size in both formats, and one that cannot be read; each sorted by the row key."""
    raw, folder = raw_flights(spark, sf_dir), fresh_path(spark, "ordered-inbox")
    parts = {"a.csv": "l_linenumber = 2", "b.parquet": "l_linenumber IN (1, 3)", "c.csv": "l_linenumber = 4", "d.parquet": "l_linenumber > 4"}
    with shuffles_dropped(spark):
        for name, condition in parts.items():
            rows = layers.sorted_by(raw.where(condition).select(*ROW_KEY, "Airline", "FlightDate"), ROW_KEY)
            layers.write_csv(rows, f"{folder}/{name}") if name.endswith(".csv") else rows.write.parquet(f"{folder}/{name}")
    raw.select(F.lit("not a parquet file")).limit(1).write.text(f"{folder}/broken.parquet")
    return folder


@query("ingest_order")
def _(spark, sf_dir):
    inbox = _inbox(spark, sf_dir)
    landed = layers.land(ingestion.ingest(spark, inbox), fresh_path(spark, "ordered"))
    drop_table(spark, inbox)
    keys = {c: ("double" if c in ("l_quantity", "l_extendedprice") else "bigint") for c in ROW_KEY}
    return number_stored_rows(landed, "fact_id").select("fact_id", *[F.col(c).try_cast(kind).alias(c) for c, kind in keys.items()])


@query("ingest_report")
def _(spark, sf_dir):
    report = ingestion.ingest_report(spark, _inbox(spark, sf_dir))
    name = F.regexp_extract("path", r"/([a-z]+\.(csv|parquet))/", 1).alias("name")
    return report.groupBy(name).agg(F.sum("n_rows").alias("n_rows"), F.max("skipped").alias("skipped"))


def _odd_inbox(spark, sf_dir):
    """CSV files of customers: with line breaks in quotes, cut short, ragged, not UTF-8, without an end, and header alone."""
    folder = fresh_path(spark, "odd-inbox")
    key = F.col("c_custkey").cast("string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").coalesce(1)
    note = F.concat_ws("", F.lit('"'), "c_name", F.lit('\n""'), "c_mktsegment", F.lit('"", '), key, F.lit('"'))
    head = F.when(F.col("c_custkey") == 0, F.lit("k,note,balance\n")).otherwise("")
    texts = {
        "breaks": F.concat(F.when(F.col("c_custkey") == 0, F.lit('\nk,"no\nte",balance\n')).otherwise(""), key, F.lit(","), note, F.lit(",1.5")),
        "short": F.concat(head, key, F.lit(",x")),
        "ragged": F.concat(head, key, F.lit(",x,2"), F.when(F.col("c_custkey") % 100 == 7, F.lit(",3")).otherwise("")),
        "quoted_ragged": F.concat(head, key, F.lit(","), note, F.lit(",2"), F.when(F.col("c_custkey") == 9, F.lit(",3")).otherwise("")),
        "unended": F.concat(head, key, F.lit(","), F.when(F.col("c_custkey") == 9, F.lit('"x')).otherwise("x"), F.lit(",2")),
    }
    for name, text in texts.items():
        customers.select(text).write.text(f"{folder}/{name}.csv")
    customers.where("c_custkey = 0").select(F.lit("k,note,balance")).write.text(f"{folder}/header.csv")
    latin = customers.select(F.concat(head, key, F.lit(",")).cast("binary").alias("b"))
    invalid = F.expr("cast(concat(b, X'E9', X'2C32') as string)")
    latin.select(invalid).write.text(f"{folder}/latin.csv")
    return folder


@query("ingest_refusals")
def _(spark, sf_dir):
    """What became of each odd file: its rows, why it was refused, and a digest of the values that were read."""
    found = ingestion.ingest_with_report(spark, _odd_inbox(spark, sf_dir))
    name = r"/([a-z_]+)\.csv/"
    note = F.coalesce("note", F.col("`no\nte`"))
    digests = found.rows.groupBy(F.regexp_extract(f"{FILE_PLACE}.file", name, 1).alias("name")).agg(
        F.sum(F.col("k").cast("bigint")).alias("keys"), F.count_if(F.contains(note, F.lit("\n"))).alias("n_breaks"),
        F.sum(F.length(note)).alias("note_chars"), F.count("balance").alias("n_balances"))
    files = found.report.select(F.regexp_extract("path", name, 1).alias("name"), "n_rows", "skipped", "reason")
    return files.join(digests, "name", "left")


@query("landing_roundtrip")
def _(spark, sf_dir):
    return landing(spark, sf_dir).drop(ROW_SEQ)


@query("curated_partitions")
def _(spark, sf_dir):
    path = fresh_path(spark, "curated")
    layers.write_curated(curated(spark, sf_dir), path)
    return layers.read_curated(spark, path).groupBy("Year", "Month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Airline").alias("n_airline"),
        F.sum("DepDelayMinutes").alias("dep_delay"),
        F.min("FlightDate").alias("first_date"), F.max("FlightDate").alias("last_date"),
    )


on_star("star_row_counts", tables.star_row_counts)


@query("orc_roundtrip")
def _(spark, sf_dir):
    path = fresh_path(spark, "fact-orc")
    layers.write_orc(star(spark, sf_dir).fact.select(*FACT_COLUMNS), path)
    return layers.read_orc(spark, path)


@query("scan_projection")
def _(spark, sf_dir):
    _, root = stored_star(spark, sf_dir)
    return read_table(spark, root + "/", "dim_origen", ["dim_origen_id", "Origin", "OriginStateName"])


@query("csv_export_roundtrip")
def _(spark, sf_dir):
    path = fresh_path(spark, "dim-csv")
    dim = star(spark, sf_dir).dims["dim_fecha"]
    layers.write_csv(dim, path)
    return spark.read.schema(dim.schema).option("header", True).csv(path)


@query("csv_sample")
def _(spark, sf_dir):
    path = fresh_path(spark, "sample-csv")
    rows = curated(spark, sf_dir)
    layers.csv_sample(rows, path)
    back = spark.read.schema(rows.drop(ROW_SEQ).schema).option("header", True).csv(path)
    return back.select(
        "FlightDate", "Airline", "Origin", "Dest", "CRSDepTime", "DepDelayMinutes", "Cancelled", "Tail_Number",
        "Year", "Month",
    )


def fact_formats(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The 25-column fact as Parquet and as ORC."""
    fact, root = star(spark, sf_dir).fact.select(*FACT_COLUMNS), fresh_path(spark, "formats")
    layers.write_tables({FACT: fact}, f"{root}/parquet")
    layers.write_orc(fact, f"{root}/orc/{FACT}")
    return {name: f"{root}/{name}/{FACT}" for name in ("parquet", "orc")}


@query("format_size_report")
def _(spark, sf_dir):
    return sizes.format_size_report(spark, fact_formats(spark, sf_dir))


# --- projections, cleaning, scalar functions ---


def _dirty_typed(spark, sf_dir, *columns):
    dirty = dirty_flights(raw_flights(spark, sf_dir))
    keyed = dirty.withColumn("_key", F.struct(*ROW_KEY))
    cleaned = typed(canonical(keyed.withColumn(ROW_SEQ, F.col("_key"))))
    return cleaned.select(f"{ROW_SEQ}.*", *columns)


QUERIES["canonical_map"] = lambda spark, sf_dir: canonical(raw_flights(spark, sf_dir))
QUERIES["clean_dates"] = lambda spark, sf_dir: _dirty_typed(spark, sf_dir, "FlightDate")
QUERIES["clean_numeric"] = lambda spark, sf_dir: _dirty_typed(
    spark, sf_dir, "Distance", "AirTime", "CRSElapsedTime", "ActualElapsedTime", "DepDelayMinutes", "ArrDelayMinutes"
)
QUERIES["clean_flags"] = lambda spark, sf_dir: _dirty_typed(
    spark, sf_dir, "Cancelled", "Diverted", "DepDel15", "ArrDel15"
)
QUERIES["clean_ints"] = lambda spark, sf_dir: _dirty_typed(
    spark, sf_dir, "DayOfWeek", "CRSDepTime", "CRSArrTime", "DistanceGroup", "Flight_Number_Operating_Airline"
)


@query("calendar_fill")
def _(spark, sf_dir):
    raw = raw_flights(spark, sf_dir).withColumns({
        "Year": F.when(F.col("l_linenumber") == 1, 2001),
        "Month": F.when(F.col("l_linenumber") == 2, 13),
        "DayOfWeek": F.when(F.col("l_linenumber") != 3, F.col("DayOfWeek")),
        ROW_SEQ: F.struct(*ROW_KEY),
    })
    return fill_calendar(typed(canonical(raw))).select(
        f"{ROW_SEQ}.*", "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek"
    )


@query("hhmm_parts")
def _(spark, sf_dir):
    line, time = F.col("l_linenumber"), F.col("CRSDepTime")
    raw = raw_flights(spark, sf_dir).select(
        *ROW_KEY,
        F.when(line == 1, F.lit(None)).when(line == 2, 2400).when(line == 3, time % 60).otherwise(time).alias("hhmm"),
    )
    hour, minute = clean.hhmm_parts(F.col("hhmm"))
    return raw.select(*ROW_KEY, "hhmm", hour.alias("hour"), minute.alias("minute"))


@query("hour_buckets")
def _(spark, sf_dir):
    return raw_flights(spark, sf_dir).select(
        *ROW_KEY, clean.hour_bucket(F.col("CRSDepTime")).alias("DepHour"),
        clean.hour_bucket(F.col("CRSArrTime")).alias("ArrHour"),
    )


@query("label_fallback")
def _(spark, sf_dir):
    raw = raw_flights(spark, sf_dir)
    labelled = raw.select(
        text.label_or(raw, ["Marketing_Airline", "Airline", "Operating_Airline"], text.NO_AIRLINE).alias("airline_label"),
        text.label_or(raw, ["Carrier"], "Sin dato").alias("missing_label"),
        text.number_or(raw, "Dep15").alias("missing_number"),
    )
    return labelled.groupBy("airline_label", "missing_label", "missing_number").agg(F.count(F.lit(1)).alias("n"))


@query("regex_columns")
def _(spark, sf_dir):
    raw = raw_flights(spark, sf_dir)
    found = {
        "airline": text.match_columns(raw, ["^carrier$", "^airline"]),
        "origin": text.match_columns(raw, ["ORIGIN$"]),
        "dep_delay": text.match_columns(raw, [r"dep.*minutes", r"delay"]),
    }
    renamed = raw.select(*[F.col(c).alias(name) for name, c in found.items()])
    return renamed.groupBy("airline", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dep_delay").alias("dep_delay")
    )


@query("norm_text")
def _(spark, sf_dir):
    messy = F.concat(
        F.lit("  ÁÉ"), F.coalesce("Airline", F.lit("")), F.lit("   Ñandú ÜBER\t"), F.col("OriginCityName"), F.lit(" ")
    )
    return raw_flights(spark, sf_dir).groupBy(
        text.norm_text(messy).alias("text"), text.norm_text(F.col("Airline")).alias("airline")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("parse_values")
def _(spark, sf_dir):
    position = ((F.col("l_orderkey") + F.col("l_linenumber")) % (len(PARSE_WORDS) + 1)).cast("int")
    words = F.array(*[F.lit(w) for w in PARSE_WORDS])
    given = raw_flights(spark, sf_dir).select(*ROW_KEY, F.get(words, position).alias("word"))
    word = F.col("word")
    return given.select(
        *ROW_KEY, text.parse_int(word).alias("as_int"), text.parse_float(word).alias("as_float"),
        text.parse_bool(word).alias("as_bool"),
    )


# --- filters ---

on_star("filter_calendar", lambda s: filtered_fact(s, CALENDAR_REQUEST).select(*FACT_COLUMNS))


@query("filter_dimensions")
def _(spark, sf_dir):
    s = star(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        filtered_fact(s, Filters(**{name: value})).select(F.lit(name).alias("filter"), "fact_id", "DepDelayMinutes")
        for name, _, value in DIM_FILTERS
    ])


@query("filter_flags")
def _(spark, sf_dir):
    s = star(spark, sf_dir)
    requests = {
        "cancelled": {"cancelled": "sí"}, "diverted": {"desviado": 1}, "flown": {"cancelado": False, "diverted": "0"},
    }
    return reduce(DataFrame.unionByName, [
        filtered_fact(s, request).select(F.lit(name).alias("filter"), "fact_id") for name, request in requests.items()
    ])


def _delayed(s: Star) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        filtered_fact(s, {"delayed15": flag}).select(F.lit(flag).alias("delayed"), "fact_id", "DepDelayMinutes")
        for flag in (True, False)
    ])


on_star("filter_delayed15", _delayed)
on_star("filter_delayed15_minutes", lambda s: _delayed(Star(s.fact.drop("DepDel15"), s.dims)))
on_star("filtered_fact", lambda s: filtered_fact(s, SEVERAL_REQUEST, ["Airline", "OriginCityName", "Dest"]).select(
    *FACT_COLUMNS, "Year", "Month", "Airline", "OriginCityName", "Dest"
))
on_star("filter_aliases", lambda s: filtered_fact(s, ALIAS_REQUEST, ["Airline"]).select(
    "fact_id", "Year", "Month", "Airline"
))


@query("resolve_dim_values")
def _(spark, sf_dir):
    s = star(spark, sf_dir)
    matches = {dim: columns for dim, columns in MATCH_COLUMNS.values()}
    return reduce(DataFrame.unionByName, [
        resolve_values(s.dims[dim], key_of(dim), matches[dim], values).select(F.lit(dim).alias("dim"), "*")
        for dim, (_, _, values) in RESOLVE_CASES.items()
    ])


on_star("filter_options", lambda s: options.filter_options(s, CALENDAR_REQUEST))

# --- dimensions and keys ---

for _name, _build in {
    "dim_date": dim_builders.dim_date, "dim_hour": dim_builders.dim_hour, "dim_airline": dim_builders.dim_airline,
    "dim_origin": dim_builders.dim_origin, "dim_dest": dim_builders.dim_dest, "dim_route": dim_builders.dim_route,
    "dim_aircraft": dim_builders.dim_aircraft, "dim_flight_no": dim_builders.dim_flight_no,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, build=_build: build(curated(spark, sf_dir))


# --- joins ---


def _lookups(spark, sf_dir, names, with_date=False):
    s = star(spark, sf_dir)
    facts = number_stored_rows(curated(spark, sf_dir), "fact_id")
    if with_date:
        facts = look_up_date(facts, s.dims)
    return reduce(lambda df, name: look_up_key(df, s.dims, name), names, facts)


@query("fk_lookup")
def _(spark, sf_dir):
    keys = ["dim_aerolinea_id", "dim_origen_id", "dim_destino_id", "dim_avion_id"]
    return _lookups(spark, sf_dir, keys, with_date=True).select("fact_id", "dim_fecha_id", *keys)


@query("fk_lookup_composite")
def _(spark, sf_dir):
    keys = ["dim_ruta_id", "dim_vuelo_id"]
    return _lookups(spark, sf_dir, keys).select("fact_id", *keys)


@query("fk_lookup_roles")
def _(spark, sf_dir):
    keys = ["dim_hora_id", "dim_hora_arr_id"]
    return _lookups(spark, sf_dir, keys).select("fact_id", *keys)


@query("fact_flights")
def _(spark, sf_dir):
    return build_fact(curated(spark, sf_dir), star(spark, sf_dir).dims).select(*FACT_COLUMNS)


@query("first_row_per_key")
def _(spark, sf_dir):
    """A dimension in whose later files every key comes again with other attributes."""
    _, root = stored_star(spark, sf_dir)
    base, dim = fresh_path(spark, "repeated"), read_table(spark, root, "dim_origen")
    first = dim.withColumn("_n", F.lit(0)).repartitionByRange(1, "dim_origen_id")
    other = dim.withColumns({"OriginCityName": F.lit(None).cast("string"), "OriginState": F.lit("A"), "_n": F.lit(1)})
    both = first.unionByName(other.repartitionByRange(1, "dim_origen_id"))
    both.drop("_n").write.parquet(f"{base}/dim_origen")
    return read_first_rows(spark, base, "dim_origen")


on_star("enriched_fact", enriched)
on_star("star_join_inner", frame.star_join_inner)

# --- analytic queries ---

on_star("kpi_summary", kpis.kpi_summary)
on_star("kpi_summary_filtered", lambda s: kpis.kpi_summary(s, SEVERAL_REQUEST))
on_star("kpi_summary_empty", lambda s: kpis.kpi_summary(s, {"anio": 1900}))
on_star("kpi_status", lambda s: kpis.kpi_status(kpis.kpi_summary(s)))
on_star("otp_departure", kpis.otp_departure)
on_star("otp_departure_long", lambda s: kpis.metric_rows(kpis.otp_departure(s)))
on_star("status_distribution", kpis.status_distribution)
on_star("airline_arr_delay", rankings.airline_arr_delay)
on_star("airline_arr_delay_filtered", lambda s: rankings.airline_arr_delay(s, CALENDAR_REQUEST))
on_star("airline_cancellations", rankings.airline_cancellations)
on_star("airline_dep_delay", rankings.airline_dep_delay)
on_star("critical_airports", rankings.critical_airports)
on_star("critical_routes", rankings.critical_routes)
on_star("critical_routes_filtered", lambda s: rankings.critical_routes(s, {**CALENDAR_REQUEST, "top": "7"}))
on_star("monthly_delay", rankings.monthly_delay)
on_star("year_options", options.year_options)
on_star("month_options", options.month_options)
on_star("flight_table", lambda s: tables.flight_table(s, {"year": 1995, "limit": 700}))


@query("topn_clamp")
def _(spark, sf_dir):
    s = star(spark, sf_dir)
    requests = {"0": {"limit": 0}, "-3": {"top": -3}, "7": {"limit": "7"}, "x": {"limit": "x"}, "999": {"limit": 999},
                "none": {}}
    return reduce(DataFrame.unionByName, [
        rankings.critical_routes(s, request).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(asked).alias("asked"), "n_rows")
        for asked, request in requests.items()
    ])


# --- models ---


def _split(spark, sf_dir):
    return frame.temporal_split(frame.ml_frame(star(spark, sf_dir)))


def _both(train: DataFrame, valid: DataFrame) -> DataFrame:
    return train.select(F.lit("train").alias("split"), "*").unionByName(
        valid.select(F.lit("validation").alias("split"), "*")
    )


on_star("ml_frame", frame.ml_frame)


@query("temporal_split")
def _(spark, sf_dir):
    return _both(*_split(spark, sf_dir)).groupBy("split", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_delayed")
    )


@query("class_distribution")
def _(spark, sf_dir):
    return frame.class_distribution(_split(spark, sf_dir)[0])


@query("top_categories")
def _(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    counts = categories.category_counts(train, categories.KEEP_COUNTS)
    return categories.most_frequent(counts, categories.KEEP_COUNTS).select("name", "value", "count")


@query("topn_other")
def _(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    reducer = categories.TopCategories().fit(train)
    return _both(reducer.transform(train), reducer.transform(valid))


@query("topn_other_all")
def _(spark, sf_dir):
    rows = frame.curated_frame(curated(spark, sf_dir))
    return categories.TopCategories().fit(rows).transform(rows).drop(ROW_SEQ)


@query("ml_sample")
def _(spark, sf_dir):
    return frame.ml_sample(frame.curated_frame(curated(spark, sf_dir))).drop(ROW_SEQ)


@query("ml_sample_bounded")
def _(spark, sf_dir):
    rows = frame.curated_frame(curated(spark, sf_dir))
    sample, late = frame.ml_sample(rows, rows=2000), F.avg("label")
    near = F.abs(F.col("share") - F.lit(rows.agg(late).first()[0])) < 0.05
    return sample.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(ROW_SEQ).alias("n_keys"), late.alias("share"),
    ).select("n_rows", "n_keys", near.alias("fair"))


@query("stratified_split")
def _(spark, sf_dir):
    train, test = frame.stratified_split(frame.curated_frame(curated(spark, sf_dir)))
    return reduce(DataFrame.unionByName, [
        part.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("split"), "label", "n")
        for name, part in (("train", train), ("test", test))
    ])


@query("string_index")
def _(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    indexed = categories.TopCategoryIndexer().fit(train).transform(valid)
    return indexed.select(*frame.CATEGORICAL, *training.INDEXED)


@query("feature_vectors")
def _(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    vectors = training.index_features().fit(train).transform(valid)
    values = vectors.select("label", vector_to_array("features").alias("v"))
    return values.select(
        "label", *[F.col("v")[i].alias(name) for i, name in enumerate((*frame.NUMERIC, *training.INDEXED))]
    )


@query("one_hot")
def _(spark, sf_dir):
    rows = frame.curated_frame(curated(spark, sf_dir))
    vectors = training.one_hot_features().fit(rows).transform(rows)
    digits = F.transform(vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return vectors.select("label", F.array_join(digits, ",").alias("features"))


def cluster_models(spark, sf_dir, *names):
    """Classifiers of the time-based job, each fitted once on the earlier years."""
    train, valid = _split(spark, sf_dir)
    fitted = _models.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    classifiers = {"lr": training.logistic_regression(), "rf": training.random_forest()}
    missing = {n: classifiers[n] for n in names if n not in fitted}
    if missing:
        fitted.update(training.fit_models(train, training.index_features(), missing))
    return {n: fitted[n] for n in names}, valid


def _metrics(models, data):
    return reduce(DataFrame.unionByName, [
        evaluate.evaluate(model, data).select(F.lit(name).alias("model"), "*") for name, model in models.items()
    ])


@query("train_lr")
def _(spark, sf_dir):
    models, valid = cluster_models(spark, sf_dir, "lr")
    return models["lr"].transform(valid).select("Year", "label", "prediction", vector_to_array("probability").alias("probability"))


@query("train_rf")
def _(spark, sf_dir):
    models, valid = cluster_models(spark, sf_dir, "rf")
    return models["rf"].transform(valid).select("Year", "label", "prediction", vector_to_array("probability").alias("probability"))


@query("evaluate_models")
def _(spark, sf_dir):
    return _metrics(*cluster_models(spark, sf_dir, "lr", "rf"))


def _ruled(spark, sf_dir):
    """Predictions by a rule on columns, as a model would return them."""
    _, valid = _split(spark, sf_dir)
    given = valid.withColumn("score", (F.col("DepHour") * 7 + F.col("DayOfWeek") * 3 + F.col("Month")) % 10 / 10.0)
    return given.withColumns({
        "prediction": F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0), "probability": F.array(1 - F.col("score"), "score"),
    })


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("confusion_matrix")
def _(spark, sf_dir):
    return evaluate.confusion_matrix(_ruled(spark, sf_dir))


@query("classification_report")
def _(spark, sf_dir):
    return _rounded(evaluate.classification_report(_ruled(spark, sf_dir)), "precision", "recall", "f1")


@query("evaluate_rule")
def _(spark, sf_dir):
    scored = _ruled(spark, sf_dir).withColumn("rawPrediction", array_to_vector("probability"))
    return _rounded(evaluate.evaluate_predictions(scored), "value")


@query("roc_area")
def _(spark, sf_dir):
    """Of a score with thousands of values and some ties."""
    ruled = _ruled(spark, sf_dir)
    fine = ruled.select("label", ((F.col("Distance") * 31 + F.col("CRSDepTime") * 7 + F.col("DayOfWeek")) % 100003).alias("score"))
    area = fine.sparkSession.createDataFrame([(evaluate.roc_area(fine),)], "area double")
    return area.select(F.lit("auc_roc").alias("metric"), F.round("area", 9).alias("value"))


@query("score_labels")
def _(spark, sf_dir):
    return _rounded(score.score_labels(_ruled(spark, sf_dir)).select(
        "CRSDepTime", "CRSArrTime", "Distance", "DayOfWeek", "Month", "prediction", "delay_pct", "on_time_pct", "verdict",
    ), "delay_pct", "on_time_pct")


def _saved_model(spark, sf_dir):
    models, valid = cluster_models(spark, sf_dir, "rf")
    path = fresh_path(spark, "model")
    training.save_model(models["rf"], path)
    return models["rf"], training.load_model(path), valid


@query("model_roundtrip")
def _(spark, sf_dir):
    """Rows that a model and its stored copy score differently."""
    model, loaded, valid = _saved_model(spark, sf_dir)

    def scores(m, name):
        return F.struct("prediction", vector_to_array("probability")).alias(name), m

    first, second = scores(model, "first"), scores(loaded, "second")
    kept = first[1].transform(valid.withColumn("_given", F.struct(*valid.columns))).select("_given", first[0])
    both = second[1].transform(kept.select("_given.*", "first")).select("first", second[0])
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("first") != F.col("second")).alias("n_differing"))


def _records(valid: DataFrame) -> DataFrame:
    """Records that leave out the arrival hour, and on some rows the arrival block."""
    return valid.drop("ArrHour", "DepDel15", "label").withColumn(
        "ArrTimeBlk", F.when(F.col("DayOfWeek") < 6, F.col("ArrTimeBlk"))
    )


@query("batch_score")
def _(spark, sf_dir):
    """How many records got each default, and how many were scored."""
    _, loaded, valid = _saved_model(spark, sf_dir)
    scored = score.batch_score(loaded, _records(valid))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ArrHour") == 11).alias("n_hour_filled"),
        F.count_if((F.col("ArrTimeBlk") == "1100-1159") & (F.col("DayOfWeek") >= 6)).alias("n_block_filled"),
        F.count_if(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9).alias("n_scored"),
    )


def _curated_split(spark, sf_dir):
    """(train, test) of the curated table: every row is in one of them."""
    return frame.stratified_split(frame.curated_frame(curated(spark, sf_dir)))


def _curated_models(spark, sf_dir, *names):
    """Models of the curated table and the search behind the last one, each fitted once."""
    train, test = _curated_split(spark, sf_dir)
    fitted = _models.setdefault((spark.sparkContext.applicationId, sf_dir, "curated"), {})
    if "baseline_lr" in names and "baseline_lr" not in fitted:
        fitted.update(training.baseline_models(train))
    if "best_lr" in names and "best_lr" not in fitted:
        found = search.search_lr(train, training.one_hot_features())
        fitted.update(best_lr=found.model, candidates=found.candidates)
    return fitted, test


@query("search_lr")
def _(spark, sf_dir):
    return _curated_models(spark, sf_dir, "best_lr")[0]["candidates"]


@query("search_rf")
def _(spark, sf_dir):
    train, _ = _curated_split(spark, sf_dir)
    return search.search_rf(train, training.one_hot_features(), refit=False).candidates


@query("train_baselines")
def _(spark, sf_dir):
    fitted, test = _curated_models(spark, sf_dir, "baseline_lr")
    return _metrics({"lr": fitted["baseline_lr"], "rf": fitted["baseline_rf"]}, test)


@query("held_out_report")
def _(spark, sf_dir):
    fitted, test = _curated_models(spark, sf_dir, "baseline_lr", "best_lr")
    return evaluate.report({name: fitted[name] for name in ("baseline_lr", "baseline_rf", "best_lr")}, test)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
