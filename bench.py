"""Time the headline queries on local cores and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. With --sql the same queries are
timed in DuckDB instead, as the baseline.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "near_theft", "theft_filter", "suspect_filter", "linked_recoveries", "theft_summary", "suspect_summary",
    "recovery_value_counts", "theft_table_stats", "reject_counts", "clean_numeric", "reproject_3857",
    "conform_compat", "standardise", "save_roundtrip", "activity_grid", "knn_risk", "eps_neighbours",
    "dbscan_thefts",
]


def time_spark(names: list[str]) -> dict[str, float]:
    from pyspark.sql import SparkSession

    from precinct.plans import model_queries, record_queries  # noqa: F401
    from precinct.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("precinct-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's machinery outside the clock
    QUERIES["theft_summary"](spark, SF_DIR).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    return times


def time_sql(names: list[str]) -> dict[str, float]:
    import duckdb

    from precinct.plans import model_queries, record_queries  # noqa: F401
    from precinct.plans.catalog import ORACLES

    con = duckdb.connect()
    con.execute(f"SET threads = {int(CPUS)}")
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    times = {}
    for name in names:
        start = time.perf_counter()
        con.execute(ORACLES[name]).to_arrow_table()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    return times


def main() -> None:
    arguments = [a for a in sys.argv[1:] if a != "--sql"]
    names = arguments or HEADLINE
    times = time_sql(names) if "--sql" in sys.argv else time_spark(names)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
