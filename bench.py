"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all), BENCH_RUNS (default 3), BENCH_QUERIES (comma-separated names).
Every query is built and run to the end (all columns computed) BENCH_RUNS times
after a warm-up; the median counts.  Message feeds are written beforehand, as a
queue dump would be, except where writing them is the query.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import gatewire
from workload import feeds
from workload.queries import QUERIES

HEADLINE = [
    "a5_authn_append",
    "a9_quarantine",
    "b4_base64",
    "b7_version_dispatch",
    "b8_brotli",
    "c5_route",
    "c6_decode_authn",
    "d1_parse_authn",
    "d2_parse_authz",
    "e10_validate_authn",
    "e10_validate_authz",
    "f5_partitioned_write",
    "f8_drop_partitions",
    "h1_time_range_scan",
    "h2_partition_stats",
    "h3_context_flatten",
    "s1_stream_authn",
    "s2_stream_authz",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = gatewire.build_session(
        "gatewire-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for feed in feeds.FEEDS:
        feeds.stored_path(spark, sf_dir, feed)

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
