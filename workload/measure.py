"""Measure decoding, checking, writing, scanning and streaming; prints a Markdown table.

    python -m workload.measure /root/testdata/sf0.1
"""

from __future__ import annotations

import datetime as dt
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

import gatewire
from gatewire.operators.envelope import decode
from gatewire.operators.parse import conform
from gatewire.sources import folders, tables
from gatewire.session import scratch_dir
from workload import feeds
from workload.queries import EVENTS_DAY, _catalog, _orders, _stream

RUNS = 5


def main(sf_dir: str) -> None:
    spark = gatewire.build_session(
        "gatewire-measure",
        master=f"local[{os.environ.get('BENCH_CPUS', os.cpu_count())}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    print("| measure | rows | median s | rows/s | note |\n|---|---|---|---|---|", flush=True)

    def report(label: str, rows: int, action, note: str = "") -> None:
        action()
        seconds = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            action()
            seconds.append(time.perf_counter() - begin)
        median = statistics.median(seconds)
        print(f"| {label} | {rows:,} | {median:.2f} | {rows / median:,.0f} | {note} |", flush=True)

    def consume(frame):
        return lambda: frame.write.format("noop").mode("overwrite").save()

    raw = feeds.stored(spark, sf_dir, "raw_messages")
    for number, label in ((0, "plain"), (1, "base64"), (2, "compressed"), (3, "base64 of compressed")):
        part = raw.where(F.col("msg_id") % 8 == number)
        report(f"decode, {label}", part.count(), consume(decode(part)))

    dimensions, open_months = gatewire.current_dimensions(spark), _catalog(spark, EVENTS_DAY)
    messages = feeds.stored(spark, sf_dir, "authn_messages")
    total = messages.count()
    checked_authn = gatewire.check_authn(messages, dimensions, open_months)
    checked_authz = gatewire.check_authz(raw, dimensions, open_months)
    report("parse and check, authn", total, consume(checked_authn))
    report("decode, parse and check, authz", total, consume(checked_authz))
    report(
        "the same and stored, authz",
        total,
        lambda: gatewire.write_checked(checked_authz, scratch_dir(spark, "measure"), "authz", "b"),
        "one write job for events and quarantine",
    )

    orders = _orders(spark, sf_dir)
    n_orders = orders.count()
    written: list[str] = []

    def append() -> None:
        written.append(scratch_dir(spark, "measure-orders"))
        tables.append_events(orders, written[-1], rebalance=True)

    report("partitioned append by month", n_orders, append)
    files = folders.matching(spark, f"{written[-1]}/created_month=*/*.parquet")
    months = folders.matching(spark, f"{written[-1]}/created_month=*")
    print(f"| files per month of the append | {len(months)} months | | | {len(files) / len(months):.1f} |", flush=True)

    stored = spark.read.parquet(written[-1])
    start, end = dt.datetime(1997, 3, 1), dt.datetime(1997, 4, 1)
    pruned = gatewire.time_range(stored, start, end)
    unpruned = stored.where((F.col("created") >= start.isoformat()) & (F.col("created") < end.isoformat()))
    for label, frame in (("with month condition", pruned), ("timestamp only", unpruned)):
        read = frame.select(F.input_file_name()).distinct().count()
        report(f"scan of one month, {label}", frame.count(), consume(frame), f"rows from {read} file(s)")

    events = conform(feeds.authn_events(spark, sf_dir), "authn")
    report("decode ids to names, authn", total, consume(gatewire.decode_names(events, "authn", dimensions)))

    def stream() -> None:
        _stream(spark, feeds.stored_path(spark, sf_dir, "authn_messages"), "authn", EVENTS_DAY)

    def batch() -> None:
        gatewire.write_checked(checked_authn, scratch_dir(spark, "measure"), "authn", "b")

    report("authn stored, batch", total, batch)
    report("authn stored, stream to the end", total, stream, "starts and stops a query each time")


if __name__ == "__main__":
    main(sys.argv[1].rstrip("/"))
