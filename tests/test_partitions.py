"""Partition planning, retention and the maintenance job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import gatewire
from gatewire.functions.months import month_end, month_start, partition_name, retention_cutoff
from gatewire.operators import partitions as p
from gatewire.plans.maintenance import maintain, run_maintenance

D = dt.date


def plan(spark, day):
    return p.plan_partitions(p.on_day(spark, day))


def to_drop(spark, day, months):
    return p.partitions_to_drop(p.on_day(spark, day), F.lit(months))


def names(frame):
    return sorted((row.schema_name, row.name) for row in frame.collect())


@pytest.mark.parametrize(
    "day, months",
    [
        (D(2023, 10, 19), ["y2023m09", "y2023m10", "y2023m11"]),
        (D(2023, 12, 9), ["y2023m11", "y2023m12", "y2024m01"]),
        (D(2024, 1, 31), ["y2023m12", "y2024m01", "y2024m02"]),
        (D(2023, 3, 31), ["y2023m02", "y2023m03", "y2023m04"]),
    ],
)
def test_plan(spark, day, months):
    expected = [(schema, f"eventlogv1_{month}") for schema in ("authentication", "authz") for month in months]
    assert names(plan(spark, day)) == sorted(expected)


@pytest.mark.parametrize(
    "day, start, end",
    [
        (D(2023, 10, 19), D(2023, 10, 1), D(2023, 11, 1)),
        (D(2023, 2, 1), D(2023, 2, 1), D(2023, 3, 1)),
        (D(2024, 2, 29), D(2024, 2, 1), D(2024, 3, 1)),
        (D(2023, 12, 31), D(2023, 12, 1), D(2024, 1, 1)),
    ],
)
def test_bounds(spark, day, start, end):
    row = spark.range(1).select(
        month_start(F.lit(day)).alias("s"), month_end(F.lit(day)).alias("e"), partition_name(F.lit(day)).alias("n")
    )
    assert row.first() == (start, end, f"eventlogv1_y{day.year}m{day.month:02}")


@pytest.mark.parametrize(
    "months, cutoff",
    [(0, D(2026, 4, 1)), (1, D(2026, 3, 1)), (2, D(2026, 2, 1)), (3, D(2026, 1, 1))],
)
def test_cutoff(spark, months, cutoff):
    assert spark.range(1).select(retention_cutoff(F.lit(D(2026, 4, 22)), months)).first()[0] == cutoff


@pytest.mark.parametrize("months, count", [(0, 46), (1, 44), (2, 42), (3, 40), (22, 2), (23, 0), (24, 0), (60, 0)])
def test_drop_list(spark, months, count):
    rows = to_drop(spark, D(2026, 4, 22), months).collect()
    assert len(rows) == len(set(rows)) == count
    cutoff = spark.range(1).select(retention_cutoff(F.lit(D(2026, 4, 22)), months)).first()[0]
    assert all(row.end_date <= cutoff for row in rows)


def test_creating_twice_changes_nothing(spark):
    once = p.create_missing(p.empty_catalog(spark), plan(spark, D(2023, 10, 19)))
    twice = p.create_missing(once, plan(spark, D(2023, 10, 19)))
    later = p.create_missing(twice, plan(spark, D(2023, 11, 1)))
    assert (once.count(), twice.count(), later.count()) == (6, 6, 8)


def test_maintain_drops_only_if_enabled(spark):
    old = plan(spark, D(2023, 8, 15))
    day = D(2023, 10, 19)
    assert maintain(old, day).count() == 10
    kept = names(maintain(old, day, enabled=True, retention_months=1))
    assert kept == names(p.create_missing(p.empty_catalog(spark), plan(spark, day)))


def test_no_retention_drops_the_month_just_made(spark):
    kept = {name for _, name in names(maintain(p.empty_catalog(spark), D(2023, 10, 19), True, 0))}
    assert kept == {"eventlogv1_y2023m10", "eventlogv1_y2023m11"}


def test_look_back_is_bounded_unless_asked_otherwise(spark):
    ancient = plan(spark, D(2019, 5, 5))
    day = D(2023, 10, 19)
    assert maintain(ancient, day, True, 1).count() == 6 + 6
    assert maintain(ancient, day, True, 1, unbounded=True).count() == 6


def test_existing(spark):
    after = maintain(p.empty_catalog(spark), D(2023, 10, 19))
    assert p.existing(plan(spark, D(2023, 11, 1)), after).count() == 4
    assert p.existing(plan(spark, D(2020, 1, 1)), after).count() == 0


def test_catalog_snapshots(spark, tmp_path):
    root = f"{tmp_path}/catalog"
    assert gatewire.load_catalog(spark, root, missing_ok=True).count() == 0
    run_maintenance(spark, root, {}, D(2023, 10, 19))
    assert gatewire.load_catalog(spark, root).count() == 6
    run_maintenance(spark, root, {}, D(2023, 11, 15))
    assert gatewire.load_catalog(spark, root).count() == 8
    # A snapshot without its end marker doesn't count.
    plan(spark, D(2000, 1, 1)).write.parquet(f"{root}/version=00000003-x")
    assert gatewire.load_catalog(spark, root).count() == 8
    run_maintenance(spark, root, {}, D(2023, 11, 16))
    assert gatewire.load_catalog(spark, root).count() == 8


def stored_months(path):
    return sorted(folder.name.split("=")[1] for folder in path.glob("created_month=*"))


@pytest.mark.parametrize("unbounded, left", [(False, ["2019-06-01", "2023-09-01"]), (True, ["2023-09-01"])])
def test_maintenance_deletes_month_folders(spark, tmp_path, unbounded, left):
    table = tmp_path / "authn"
    rows = [(dt.datetime(*parts),) for parts in [(2019, 6, 1), (2022, 7, 1), (2023, 8, 31, 23), (2023, 9, 1)]]
    gatewire.append_events(spark.createDataFrame(rows, "created timestamp"), str(table))
    paths = {"authn": str(table), "authz": f"{tmp_path}/none"}
    arguments = (spark, f"{tmp_path}/catalog", paths, D(2023, 10, 19))
    assert run_maintenance(*arguments) == []
    deleted = run_maintenance(*arguments, enabled=True, retention_months=1, unbounded=unbounded)
    assert len(deleted) == 4 - len(left)
    assert stored_months(table) == left
    assert run_maintenance(*arguments, enabled=True, retention_months=1, unbounded=unbounded) == []
