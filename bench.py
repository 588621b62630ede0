"""Time the registered queries at $BENCH_SF_DIR and print one JSON line.

Building the landing table and the star is timed as queries of its own; the
other queries read the star, as a dashboard would. Every query runs once to
warm up and then BENCH_RUNS times into a noop sink; the mean is reported.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from aeroledger.binding import flights_raw
from aeroledger.catalog import queries as catalog
from aeroledger.session import build_session
from aeroledger.sources.datamart import build_star
from aeroledger.sources.layers import land
from aeroledger.sources.sizes import mean_delay_by_airline
from aeroledger.workspace import fresh_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "kpi_summary", "kpi_summary_filtered", "otp_departure", "status_distribution",
    "airline_arr_delay", "airline_cancellations", "airline_dep_delay", "critical_airports",
    "critical_routes", "critical_routes_filtered", "monthly_delay", "filter_options", "flight_table",
    "filtered_fact", "enriched_fact", "star_join_inner", "ml_frame", "top_categories", "topn_other",
    "star_row_counts", "curated_partitions",
)
MODELS = ("train_lr", "train_rf")


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(function, runs: int = 1) -> float:
    started = time.perf_counter()
    for _ in range(runs):
        function()
    return round((time.perf_counter() - started) / runs, 4)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or [*HEADLINE, *MODELS]
    key = (spark.sparkContext.applicationId, SF_DIR)

    def landing():
        return land(flights_raw(spark, SF_DIR, in_order=True), fresh_path(spark, "landing"))

    def star(landed):
        root = fresh_path(spark, "datamart")
        return build_star(landed, root), root

    results = {}
    landing()  # warm-up
    results["build_landing"] = timed(lambda: catalog._landings.__setitem__(key, landing()))
    star(catalog._landings[key])  # warm-up
    results["build_star"] = timed(lambda: catalog._stars.__setitem__(key, star(catalog._landings[key])))

    for name, path in catalog.fact_formats(spark, SF_DIR).items():
        read = lambda: sink(mean_delay_by_airline(spark.read.format(name).load(path)))
        read()
        results[f"read_agg_{name}"] = timed(read, RUNS)

    for name in names:
        run = catalog.QUERIES[name]
        if name in MODELS:
            results[name] = timed(lambda: sink(run(spark, SF_DIR)))  # includes the fit, once
            continue
        sink(run(spark, SF_DIR))
        results[name] = timed(lambda: sink(run(spark, SF_DIR)), RUNS)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
