"""How message feeds are made of the events table."""

import datetime as dt

import pytest

from workload import feeds


@pytest.fixture
def few_events(spark, tmp_path):
    day = dt.datetime(2024, 1, 5)
    rows = [(i, day + dt.timedelta(minutes=i), i % 7, "view", 1.5, f'{{"k": {i % 100}}}') for i in range(200)]
    rows += [rows[3], (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", frame.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["authn_messages", "authz_documents", "raw_messages", "authz_table"])
def test_events_are_dealt_before_messages_are_made(spark, few_events, name):
    feed = spark.read.parquet(feeds.stored_path(spark, few_events, name))
    assert len(feed.inputFiles()) > 1
    dealt = feeds.FEEDS[name](spark, few_events, 3)
    optimized = dealt._jdf.queryExecution().optimizedPlan().toString().splitlines()
    [place] = [n for n, line in enumerate(optimized) if "Repartition 3" in line]
    assert all("parquet" in line or "props" in line for line in optimized[place + 1 :] if line.strip())
    # as soon as it is dealt out, an event is no message yet
    assert not any("body" in line or "json" in line for line in optimized[place:])

    def printed(rows):
        return sorted(map(str, rows.collect()))

    assert printed(dealt) == printed(feed) == printed(feeds.FEEDS[name](spark, few_events))
