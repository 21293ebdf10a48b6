"""Tables, quarantine, lookup tables and reading back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import gatewire
from gatewire import vocabulary as v
from gatewire.operators import lookups, partitions, readouts
from gatewire.plans.ingest import check_authn, check_authz
from gatewire.sources import folders, tables
from gatewire.sources.dimensions import DIMENSIONS, literal_dimension

from samples import AUTHN, AUTHZ, CONTEXT, text


def catalog(spark, day=dt.date(2023, 9, 7)):
    return partitions.plan_partitions(partitions.on_day(spark, day))


def authn_messages(spark, documents):
    return spark.createDataFrame(list(enumerate(documents)), "msg_id long, body string")


def times(spark, *instants):
    rows = [(i, text) for i, text in enumerate(instants)]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.to_timestamp("t").alias("created"))


def test_batch_is_stored_once_and_replaced_on_replay(spark, dimensions, tmp_path):
    root = f"{tmp_path}/authn"
    documents = [text(AUTHN, UserId=i) for i in range(20)] + ["null", text(AUTHN, Created=...)]
    checked = check_authn(authn_messages(spark, documents), dimensions, catalog(spark))
    for _ in range(2):
        gatewire.write_checked(checked, root, "authn", "feed-1")
    gatewire.write_checked(checked, root, "authn", "feed-2")
    assert gatewire.read_accepted(spark, root, "authn").count() == 40
    assert gatewire.read_quarantine(spark, root).count() == 4
    refused = {r.msg_id: (bytes(r.body), r.errors) for r in gatewire.read_quarantine(spark, root).collect()}
    assert refused[20] == (b"null", {"not_object": "body"})
    assert refused[21][1] == {"created_missing": "Created"}
    months = gatewire.read_accepted(spark, root, "authn").select("created_month").distinct().collect()
    assert [row[0] for row in months] == [dt.date(2023, 9, 1)]


def test_unnamed_batches_are_appended(spark, dimensions, tmp_path):
    checked = check_authn(authn_messages(spark, [text(AUTHN)]), dimensions, catalog(spark))
    for _ in range(3):
        gatewire.write_checked(checked, str(tmp_path), "authn")
    assert gatewire.read_accepted(spark, str(tmp_path), "authn").count() == 3
    assert gatewire.read_quarantine(spark, str(tmp_path)).count() == 0


def test_forget_batch(spark, dimensions, tmp_path):
    root = str(tmp_path)
    messages = authn_messages(spark, [text(AUTHN)])
    gatewire.write_checked(check_authn(messages, dimensions, catalog(spark)), root, "authn", "a")
    gatewire.write_checked(check_authn(messages, dimensions, catalog(spark)), root, "authn", "b")
    # The month is gone when the batch is tried again: the message changes sides.
    tables.forget_batch(spark, root, "a")
    gatewire.write_checked(check_authn(messages, dimensions, catalog(spark, dt.date(2030, 1, 1))), root, "authn", "a")
    assert gatewire.read_accepted(spark, root, "authn").count() == 1
    assert gatewire.read_quarantine(spark, root).first().errors == {"no_partition": "Created"}


def test_nothing_stored_yet(spark, tmp_path):
    assert gatewire.read_accepted(spark, f"{tmp_path}/x", "authz").count() == 0
    assert gatewire.read_quarantine(spark, f"{tmp_path}/x").count() == 0


def test_context_survives_storage(spark, dimensions, tmp_path):
    import json

    messages = spark.createDataFrame([(1, text(AUTHZ).encode())], "msg_id long, body binary")
    checked = check_authz(messages, dimensions, catalog(spark, dt.date(2018, 6, 1)))
    gatewire.write_checked(checked, str(tmp_path), "authz", "b")
    stored = gatewire.read_accepted(spark, str(tmp_path), "authz")
    assert dict(stored.dtypes)["contextrequestjson"] == "variant"
    assert json.loads(stored.select(F.to_json("contextrequestjson")).first()[0]) == CONTEXT


@pytest.mark.parametrize("rebalance", [False, True])
def test_append_by_month(spark, tmp_path, rebalance):
    events = times(spark, "2024-01-31 23:59:59.999999", "2024-02-01 00:00:00", "2023-12-31 00:00:00")
    gatewire.append_events(events, str(tmp_path), rebalance)
    months = {folder.rsplit("=", 1)[1] for folder in folders.matching(spark, f"{tmp_path}/created_month=*")}
    assert months == {"2024-01-01", "2024-02-01", "2023-12-01"}
    assert [str(m) for m in tables.stored_months(spark, str(tmp_path))] == sorted(months)


def test_hot_month_is_split_when_rebalancing(spark, tmp_path):
    """Nearly all rows in one month end up in several files, not in one task."""
    days = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 50 == 0, F.timestamp_seconds(F.col("id") * 500))
        .otherwise(F.lit("2024-01-05").cast("timestamp"))
        .alias("created"),
        F.md5(F.col("id").cast("string")).alias("sessionid"),
    )
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        gatewire.append_events(days, str(tmp_path), rebalance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(list(tmp_path.glob("created_month=2024-01-01/*.parquet"))) > 2
    assert spark.read.parquet(str(tmp_path)).count() == 200_000


def test_time_range_prunes_folders_and_is_half_open(spark, tmp_path):
    gatewire.append_events(
        times(spark, "2024-01-31 23:59:59.999999", "2024-02-01", "2024-02-29 12:00:00", "2024-03-01", "2024-04-01"),
        str(tmp_path),
    )
    stored = spark.read.parquet(str(tmp_path))

    def ids(start, end):
        return sorted(row.id for row in readouts.time_range(stored, start, end).collect())

    assert ids(dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)) == [1, 2]
    assert ids(dt.datetime(2024, 1, 31, 23, 59, 59, 999999), dt.datetime(2024, 2, 1)) == [0]
    assert ids(dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1)) == []
    assert ids(dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1)) == [0, 1, 2, 3, 4]
    plan = readouts.time_range(stored, dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "created_month" in physical.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(created" in physical.split("PushedFilters: [")[1]


def test_range_reads_only_its_months(spark, dimensions, tmp_path):
    days = ("2023-08-01", "2023-09-30", "2023-10-01")
    documents = [text(AUTHN, SessionId=day, Created=f"{day}T10:00:00Z") for day in days]
    checked = check_authn(authn_messages(spark, documents), dimensions, catalog(spark))
    gatewire.write_checked(checked, str(tmp_path), "authn", "b1")
    gatewire.write_checked(checked, str(tmp_path), "authn", "b2")
    september = (dt.datetime(2023, 9, 1), dt.datetime(2023, 10, 1))
    found = gatewire.read_accepted_range(spark, str(tmp_path), "authn", *september)
    assert [r.sessionid for r in found.collect()] == ["2023-09-30"] * 2
    assert all("created_month=2023-09-01" in path for path in found.inputFiles())
    assert found.columns[-1] == "created_month"
    earlier = (dt.datetime(2022, 1, 1), dt.datetime(2023, 1, 1))
    none = gatewire.read_accepted_range(spark, str(tmp_path), "authn", *earlier)
    assert none.count() == 0


def test_many_months_in_one_task(spark, tmp_path):
    """More months than files a task keeps open at a time."""
    days = spark.range(0, 3000, 1, 1).select(F.timestamp_seconds(F.col("id") * 86400).alias("created"))
    gatewire.append_events(days, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).distinct().count() == 3000
    assert len(tables.stored_months(spark, str(tmp_path))) == 99


def test_partition_stats_show_empty_months(spark):
    events = readouts.with_partition(times(spark, "2023-09-03", "2023-09-01", "2023-10-31"), "authz")
    events = events.unionByName(readouts.with_partition(times(spark, "2023-08-05"), "authn"))
    stats = readouts.partition_stats(events, catalog(spark))
    assert {(r.schema_name, r.name[-3:], r.n_rows) for r in stats.collect()} == {
        ("authz", "m08", 0), ("authz", "m09", 2), ("authz", "m10", 1),
        ("authentication", "m08", 1), ("authentication", "m09", 0), ("authentication", "m10", 0),
    }
    rows = stats.where("schema_name = 'authz'").collect()
    days = [(r.name[-3:], r.n_rows, *(t and t.day for t in (r.first_created, r.last_created))) for r in rows]
    assert sorted(days) == [("m08", 0, None, None), ("m09", 2, 1, 3), ("m10", 1, 31, 31)]


def test_flatten_context(spark):
    frame = spark.createDataFrame([(1, text(CONTEXT)), (2, "{}"), (3, None)], "id int, j string")
    flat = readouts.flatten_context(frame.select("id", F.parse_json("j").alias("contextrequestjson")), ("id",))
    rows = [(r.id, r.category, r.attribute_id, r.value) for r in flat.orderBy("id").collect()]
    assert rows[:5] == [
        (1, "access-subject", "org", "unit9"),
        (1, "access-subject", "role", "clerk"),
        (1, "access-subject", "role", "head"),
        (1, "action", "action-id", "read"),
        (1, "environment", None, None),
    ]
    assert rows[5:] == [(2, None, None, None), (3, None, None, None)]


def test_yearly_chunks_and_generations(spark, tmp_path):
    old = times(spark, "2020-12-31 23:59:59", "2021-01-01").withColumn("sessionid", F.lit("old"))
    gatewire.rewrite_by_year(old, f"{tmp_path}/v0")
    assert len(folders.matching(spark, f"{tmp_path}/v0/created_year=*")) == 2
    new = old.withColumn("subject_party_uuid", F.lit("u"))
    both = gatewire.union_generations(spark.read.parquet(f"{tmp_path}/v0").drop("created_year"), new)
    assert both.columns == new.columns and both.count() == 4
    assert both.where("subject_party_uuid IS NULL").count() == 2


def test_dimensions_are_stored_and_brought_up_to_date(spark, tmp_path):
    gatewire.save_dimensions(gatewire.seed_dimensions(spark), str(tmp_path))
    loaded = gatewire.load_dimensions(spark, str(tmp_path))
    assert [loaded[name].count() for name in DIMENSIONS] == [4, 22, 5, 4]
    later = literal_dimension(spark, v.AUTHENTICATION_METHOD_LATER_ROWS + [(1, "other", "other")])
    grown = gatewire.insert_if_absent(loaded["authenticationmethod"], later)
    everything = v.AUTHENTICATION_METHOD_ROWS + v.AUTHENTICATION_METHOD_LATER_ROWS
    assert sorted(map(tuple, grown.collect())) == sorted(everything)
    assert gatewire.insert_if_absent(grown, later).count() == 24


def test_vocabularies_stay_apart():
    stored = {id_: name for id_, name, _ in v.AUTHENTICATION_METHOD_ROWS}
    assert v.WIRE_AUTHENTICATION_METHOD["MaskinPorten"] == 16
    assert stored[16] == "EnterpriseMaskinportenIdentified" and stored[20] == "MaskinPorten"


def test_reference_check_ignores_null(spark, dimensions):
    events = spark.createDataFrame([(1, 1), (2, None), (3, 99)], "id int, eventtypeid int")
    found = lookups.violators(events, lookups.reference("fk_eventtype"), dimensions["authenticationeventtype"])
    assert [row.id for row in found.collect()] == [3]


def test_route(spark):
    events = times(spark, "2023-07-31 23:59:59", "2023-08-01", "2023-10-31 23:59:59.999999", "2023-11-01")
    fits, others = lookups.route(events, catalog(spark), "authz")
    assert sorted(r.id for r in fits.collect()) == [1, 2]
    assert sorted(r.id for r in others.collect()) == [0, 3]
