"""Second try for refused messages, replays, and lookups with repeated rows."""

import datetime as dt
import string

import pytest
from pyspark.sql import functions as F

import gatewire
from gatewire.operators import lookups, partitions
from gatewire.plans.ingest import check_authn, check_authz
from gatewire.sources import batches, folders, tables

from samples import AUTHN, AUTHZ, checked_events, text, v01


def months(spark, *days):
    plans = [partitions.plan_partitions(partitions.on_day(spark, day)) for day in days]
    result = partitions.empty_catalog(spark)
    for plan in plans:
        result = partitions.create_missing(result, plan)
    return result


def day(n):
    return text(AUTHN, SessionId=n, Created=f"{n}T12:00:00Z")


@pytest.fixture
def refused(spark, dimensions, tmp_path):
    """Two batches and an unnamed one: an event each of March and June, and one that is no document."""
    root = str(tmp_path / "authn")
    rows = [(1, day("2024-03-05")), (2, day("2024-06-05")), (3, "null")]
    for batch in ("one", "two~x", None):
        messages = spark.createDataFrame(rows, "msg_id long, body string")
        checked = check_authn(messages, dimensions, months(spark, dt.date(2023, 1, 1)))
        gatewire.write_checked(checked, root, "authn", batch)
    return root


def state(spark, root):
    taken = sorted(r.sessionid for r in gatewire.read_accepted(spark, root, "authn").collect())
    return taken, sorted(r.msg_id for r in gatewire.read_quarantine(spark, root).collect())


def test_messages_pass_once_their_month_is_there(spark, dimensions, refused):
    assert state(spark, refused) == ([], [1, 1, 1, 2, 2, 2, 3, 3, 3])
    march, both = months(spark, dt.date(2024, 3, 1)), months(spark, dt.date(2024, 3, 1), dt.date(2024, 6, 1))
    assert gatewire.reprocess(spark, refused, "authn", dimensions, march) > 0
    assert state(spark, refused) == (["2024-03-05"] * 3, [2, 2, 2, 3, 3, 3])
    for _ in range(2):
        gatewire.reprocess(spark, refused, "authn", dimensions, both)
        assert state(spark, refused) == (["2024-03-05"] * 3 + ["2024-06-05"] * 3, [3, 3, 3])


@pytest.mark.parametrize("dies", ["before writing", "before the list", "before deleting", "while deleting"])
def test_a_run_that_dies_is_made_good(spark, dimensions, refused, monkeypatch, dies):
    march = months(spark, dt.date(2024, 3, 1))
    with monkeypatch.context() as patch:
        if dies == "before writing":
            patch.setattr(tables, "store", lambda *_: 1 / 0)
        elif dies == "before the list":
            patch.setattr(folders, "create_whole", lambda *_: 1 / 0)
        else:
            deleted = []

            def some(spark, path, really=folders.delete):
                if len(deleted) == (dies == "while deleting"):
                    raise ZeroDivisionError
                deleted.append(path)
                really(spark, path)

            patch.setattr(folders, "delete", some)
        with pytest.raises(ZeroDivisionError):
            gatewire.reprocess(spark, refused, "authn", dimensions, march)
    gatewire.reprocess(spark, refused, "authn", dimensions, march)
    assert state(spark, refused) == (["2024-03-05"] * 3, [2, 2, 2, 3, 3, 3])
    # a run that died isn't a try, or is one: never more than that
    assert {r.attempts for r in gatewire.read_quarantine(spark, refused).collect()} <= {2, 3}


MARCH = ("2024-03",)


def put(spark, root, batch, days, open_months=MARCH, **more):
    checked = checked_events(spark, [(d, f"{d}T12:00:00") for d in days], open_months)
    gatewire.write_checked(checked, root, "authn", batch, **more)


def test_names_that_look_like_further_tries(spark, dimensions, tmp_path):
    """A user's batch x~1 isn't what was made of the refused messages of x."""
    root, march = str(tmp_path / "t"), months(spark, dt.date(2024, 3, 1))
    put(spark, root, "x", ["1990-01-01"])
    for name in ("x~1", "x~r1", "x~7Er1"):
        put(spark, root, name, ["2024-03-01", "2024-03-02"])
    gatewire.reprocess(spark, root, "authn", dimensions, march)
    assert state(spark, root) == (["2024-03-01"] * 3 + ["2024-03-02"] * 3, [0])


ODD_NAMES = ["day-*", "day-1", "day-2", "2024-05-01T10:00", "{a,b}", "[a-z]", "a%2Fb", "a/b", "x~1", "bulk", "~u", "æ ø", "a=b", "?", "^", "\\", "..", "_x", ".x"]


def test_every_name_has_a_folder_of_its_own():
    found = [batches.folder_of(name) for name in ODD_NAMES]
    assert len(set(found)) == len(found)
    assert all(set(name) <= set(string.ascii_letters + string.digits + "~-._") for name in found)
    reserved = (batches.UNNAMED, batches.MERGED)
    assert not any(name.startswith(reserved) or batches.next_try(name) != f"{name}~r1" for name in found)
    assert batches.next_try("a~r9") == "a~r10" and batches.folder_of(None) != batches.folder_of(None)


def test_any_name_stands_for_itself(spark, dimensions, tmp_path):
    """No name matches another one's folder, and each replaces what it stored itself."""
    root = str(tmp_path / "t")
    names = ["day-1", "day-2", "day-*", "2024-05-01T10:00", "[a-z]{,}%2F~?/x"]
    for name in [*names, *names[2:]]:
        put(spark, root, name, ["2024-03-01", "1990-01-01"])
    assert state(spark, root) == (["2024-03-01"] * len(names), [1] * len(names))
    with pytest.raises(ValueError):
        put(spark, root, "", ["2024-03-01"])


def test_unnamed_rows_have_no_name_to_be_replaced_by(spark, dimensions, tmp_path):
    root = str(tmp_path / "t")
    for name in (None, "bulk", None, "bulk", None):
        put(spark, root, name, ["2024-03-01"])
    assert gatewire.read_accepted(spark, root, "authn").count() == 4


def test_a_replay_replaces_what_was_made_of_its_refused_messages(spark, dimensions, tmp_path):
    root, march = str(tmp_path / "t"), months(spark, dt.date(2024, 3, 1))
    put(spark, root, "b", ["2024-03-01", "1990-01-01"], ())
    gatewire.reprocess(spark, root, "authn", dimensions, march)
    assert state(spark, root) == (["2024-03-01"], [1])
    put(spark, root, "b", ["2024-03-01", "1990-01-01"])
    assert state(spark, root) == (["2024-03-01"], [1])


def test_messages_rest_after_enough_tries(spark, dimensions, refused):
    none = months(spark, dt.date(2023, 1, 1))
    counts = []
    for _ in range(5):
        gatewire.reprocess(spark, refused, "authn", dimensions, none, tries=3)
        waiting, resting = gatewire.read_quarantine(spark, refused), gatewire.read_resting(spark, refused)
        counts.append((waiting.count(), resting.count()))
    assert counts == [(9, 0)] + [(0, 9)] * 4
    rows = gatewire.read_resting(spark, refused).collect()
    assert {r.attempts for r in rows} == {3}
    assert {(r.msg_id, *r.errors) for r in rows} == {(1, "no_partition"), (2, "no_partition"), (3, "not_object")}
    # resting ones are no more work
    assert gatewire.reprocess(spark, refused, "authn", dimensions, months(spark, dt.date(2024, 3, 1))) == 0


def test_many_batches_in_several_jobs(spark, dimensions, refused):
    march = months(spark, dt.date(2024, 3, 1))
    assert gatewire.reprocess(spark, refused, "authn", dimensions, march, at_once=2) == 3
    assert state(spark, refused) == (["2024-03-05"] * 3, [2, 2, 2, 3, 3, 3])


def test_refused_messages_go_by_their_arrival(spark, dimensions, tmp_path):
    """Old ones go, young ones in the same run stay, tried again or resting; events aren't concerned."""
    root, march = str(tmp_path / "t"), months(spark, dt.date(2024, 3, 1))
    for month in (1, 5, 7):
        put(spark, root, f"m{month}", ["2024-03-01", "1990-01-01"], arrived=dt.datetime(2024, month, 31, 23, 59))
    gatewire.reprocess(spark, root, "authn", dimensions, march)
    put(spark, root, "m5b", ["1990-01-01"], arrived=dt.datetime(2024, 5, 1))
    gatewire.reprocess(spark, root, "authn", dimensions, march, tries=3)

    def left():
        kept = gatewire.read_quarantine(spark, root).unionByName(gatewire.read_resting(spark, root))
        return sorted((r.arrived.month, r.attempts) for r in kept.select("attempts", F.col("arrived").cast("timestamp_ntz").alias("arrived")).collect())

    assert left() == [(1, 3), (5, 2), (5, 3), (7, 3)]

    def run(kept):
        return gatewire.run_maintenance(
            spark, f"{tmp_path}/c", {}, dt.date(2024, 7, 2), enabled=True, retention_months=24, refused=[root], refused_months=kept
        )

    assert run(None) == [] and run(6) == []
    assert run(2) and left() == [(5, 2), (5, 3), (7, 3)]
    assert run(1) and left() == [(7, 3)]
    assert not run(0) and left() == [(7, 3)]
    assert gatewire.read_accepted(spark, root, "authn").count() == 3


def test_enveloped_messages(spark, dimensions, tmp_path):
    rows = [(1, v01(text(AUTHZ).encode())), (2, b"99abc")]
    messages = spark.createDataFrame(rows, "msg_id long, body binary")
    root, month = str(tmp_path / "authz"), dt.date(2018, 5, 1)
    gatewire.write_checked(check_authz(messages, dimensions, months(spark, dt.date(2000, 1, 1))), root, "authz")
    gatewire.reprocess(spark, root, "authz", dimensions, months(spark, month))
    assert gatewire.read_accepted(spark, root, "authz").count() == 1
    assert [r.msg_id for r in gatewire.read_quarantine(spark, root).collect()] == [2]


def test_nothing_refused(spark, dimensions, tmp_path):
    assert gatewire.reprocess(spark, str(tmp_path / "none"), "authn", dimensions, months(spark)) == 0


def test_a_named_batch_replaces_its_earlier_try_wherever_that_went(spark, dimensions, tmp_path):
    root, messages = str(tmp_path / "t"), spark.createDataFrame([(1, day("2024-03-05"))], "msg_id long, body string")
    for open_months in (months(spark, dt.date(2000, 1, 1)), months(spark, dt.date(2024, 3, 1))):
        tables.write_checked(check_authn(messages, dimensions, open_months), root, "authn", "b")
    assert state(spark, root) == (["2024-03-05"], [])


def test_repeated_lookup_and_catalog_rows_do_not_multiply_events(spark, dimensions):
    twice = {name: rows.unionByName(rows) for name, rows in dimensions.items()}
    open_months = months(spark, dt.date(2023, 9, 1))
    messages = spark.createDataFrame([(1, text(AUTHN))], "msg_id long, body string")
    checked = check_authn(messages, twice, open_months.unionByName(open_months))
    assert checked.count() == 1 and checked.first().is_valid
    assert gatewire.decode_names(gatewire.accepted(checked, "authn"), "authn", twice).count() == 1


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_first_of_several_new_lookup_rows_wins(spark, dimensions, parts):
    rows = spark.range(1000).select(
        F.lit(99).alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("d").alias("description")
    )
    got = lookups.insert_if_absent(dimensions["decision"], rows.repartition(parts)).where("id = 99").collect()
    assert [r.name for r in got] == ["n0"]


def test_a_missing_list_of_partitions_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        gatewire.load_catalog(spark, f"{tmp_path}/none")
    assert gatewire.load_catalog(spark, f"{tmp_path}/none", missing_ok=True).count() == 0


def test_lists_of_jobs_side_by_side_do_not_meet(spark, tmp_path):
    root = f"{tmp_path}/c"
    for n in range(8):
        gatewire.save_catalog(months(spark, dt.date(2000 + n, 1, 1)), root)
    assert gatewire.load_catalog(spark, root).agg(F.max("start_date")).first()[0] == dt.date(2007, 2, 1)
    assert len(folders.matching(spark, f"{root}/list-*")) == 5
    spark.range(1).write.parquet(f"{root}/list-unfinished")
    assert gatewire.load_catalog(spark, root).agg(F.max("start_date")).first()[0] == dt.date(2007, 2, 1)


def test_grouping_needs_adaptive_execution(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "created timestamp")
        with pytest.raises(ValueError):
            gatewire.append_events(events, f"{tmp_path}/e", rebalance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
