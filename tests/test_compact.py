"""Joined files, what was noted of files, and readers, replays and retention around them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import gatewire
from gatewire.operators import partitions, readouts
from gatewire.plans import compact as compaction
from gatewire.plans.ingest import check_authz
from gatewire.sources import batches, commits, folders, merged, tables, zones

from samples import AUTHZ, checked_events, text

MARCH, APRIL = "2024-03-01", "2024-04-01"


@pytest.fixture
def open_months(spark):
    return partitions.plan_partitions(partitions.on_day(spark, dt.date(2024, 3, 5)))


@pytest.fixture
def put(spark, tmp_path):
    """Store events of some instants as a batch."""

    def store(batch, *instants):
        checked = checked_events(spark, [(f"{batch}/{i}", at) for i, at in enumerate(instants)], ("2024-02", "2024-03", "2024-04"))
        gatewire.write_checked(checked, str(tmp_path), "authn", batch)

    return store


def ids(spark, root, *between):
    rows = gatewire.read_accepted_range(spark, str(root), "authn", *between) if between else gatewire.read_accepted(spark, str(root), "authn")
    return sorted(row.sessionid for row in rows.select("sessionid").collect())


def stored(root, month):
    return sorted(str(path) for path in root.glob(f"verdict=accepted/created_month={month}/*/*.parquet"))


def test_a_month_of_small_batches_becomes_few_files(spark, tmp_path, put):
    for n in range(6):
        put(f"b{n}", f"2024-03-{n + 1:02d}T10:00:00", f"2024-04-{n + 1:02d}T10:00:00")
    before = ids(spark, tmp_path)
    assert gatewire.compact(spark, str(tmp_path), "authn", [MARCH], grace=0) == {MARCH: 6}
    assert ids(spark, tmp_path) == before and len(stored(tmp_path, MARCH)) == 7
    assert gatewire.compact(spark, str(tmp_path), "authn", [MARCH], grace=0) == {}
    assert ids(spark, tmp_path) == before and len(stored(tmp_path, MARCH)) == 1 and len(stored(tmp_path, APRIL)) == 6
    put("b7", "2024-03-09T10:00:00")
    assert gatewire.compact(spark, str(tmp_path), "authn") == {MARCH: 2, APRIL: 6}
    assert ids(spark, tmp_path) == sorted([*before, "b7/0"])
    columns = gatewire.read_accepted(spark, str(tmp_path), "authn").columns
    assert merged.ORIGIN not in columns and columns[-1] == "created_month"


def test_readers_see_old_or_new(spark, tmp_path, put, monkeypatch):
    """At every step of joining there are the same rows, and a reader from before it can go on."""
    root = str(tmp_path)
    for n in range(3):
        put(f"b{n}", f"2024-03-0{n + 1}T10:00:00")
    seen = []

    def looking(name, really):
        def step(*arguments):
            seen.append((name, len(ids(spark, tmp_path))))
            result = really(*arguments)
            seen.append((name, len(ids(spark, tmp_path))))
            return result

        return step

    for name in ("announce", "write", "replace"):
        monkeypatch.setattr(merged, name, looking(name, getattr(merged, name)))
    early = gatewire.read_accepted(spark, root, "authn")
    gatewire.compact(spark, root, "authn")
    assert [n for _, n in seen] == [3] * 6 and early.count() == 3


@pytest.mark.parametrize("dies", ["write", "replace", "clean"])
def test_joining_that_dies(spark, tmp_path, put, monkeypatch, dies):
    for n in range(3):
        put(f"b{n}", f"2024-03-0{n + 1}T10:00:00")
    if dies == "clean":
        gatewire.compact(spark, str(tmp_path), "authn")
    with monkeypatch.context() as patch:
        if dies == "write":
            really = merged.write
            patch.setattr(merged, "write", lambda *a: (really(*a), 1 / 0))
        elif dies == "replace":
            patch.setattr(commits, "claim", lambda *a, really=commits.claim: really(*a) if a[3] == "{}" else 1 / 0)
        else:
            patch.setattr(folders, "delete", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            gatewire.compact(spark, str(tmp_path), "authn", grace=0)
    assert len(ids(spark, tmp_path)) == 3
    gatewire.compact(spark, str(tmp_path), "authn", grace=0)
    gatewire.compact(spark, str(tmp_path), "authn", grace=0)
    assert len(ids(spark, tmp_path)) == 3 and len(stored(tmp_path, MARCH)) == 1


def test_a_joined_batch_is_stored_again(spark, tmp_path, put):
    """A replay replaces the rows of the batch in the joined files too, before and after its old folder is gone."""
    put("a", "2024-03-01T10:00:00", "2024-03-02T10:00:00")
    put("b", "2024-03-03T10:00:00", "2024-04-03T10:00:00")
    for grace in (3600, 0, 0):
        gatewire.compact(spark, str(tmp_path), "authn", at_least=1, grace=grace)
        put("b", "2024-03-04T10:00:00")
        assert ids(spark, tmp_path) == ["a/0", "a/1", "b/0"]
        put("b", "2024-03-03T10:00:00", "2024-04-03T10:00:00")
        assert ids(spark, tmp_path) == ["a/0", "a/1", "b/0", "b/1"]


def test_a_batch_that_is_stored_again_while_it_is_joined(spark, tmp_path, put, monkeypatch):
    put("a", "2024-03-01T10:00:00")
    put("b", "2024-03-03T10:00:00", "2024-03-04T10:00:00")
    with monkeypatch.context() as patch:
        really = merged.write

        def meanwhile(*arguments):
            name = really(*arguments)
            patch.undo()
            put("b", "2024-03-05T10:00:00")
            return name

        patch.setattr(merged, "write", meanwhile)
        assert gatewire.compact(spark, str(tmp_path), "authn") == {}
    assert ids(spark, tmp_path) == ["a/0", "b/0"]
    # and between the last look and the claim
    with monkeypatch.context() as patch:
        really_claim = commits.claim

        def late(*arguments):
            if "at" in arguments[3]:
                patch.undo()
                put("b", "2024-03-06T10:00:00", "2024-03-07T10:00:00")
            return really_claim(*arguments)

        patch.setattr(commits, "claim", late)
        assert gatewire.compact(spark, str(tmp_path), "authn") == {}
    assert ids(spark, tmp_path) == ["a/0", "b/0", "b/1"]
    # and right after the claim, when the joined folder counts already
    with monkeypatch.context() as patch:

        def early(*arguments):
            if "at" in arguments[3]:
                patch.undo()
                for path in batches.paths(spark, str(tmp_path), folder="b"):
                    folders.delete(spark, path)
                claimed = really_claim(*arguments)
                put("b", "2024-03-08T10:00:00")
                return claimed
            return really_claim(*arguments)

        patch.setattr(commits, "claim", early)
        gatewire.compact(spark, str(tmp_path), "authn")
    assert ids(spark, tmp_path) == ["a/0", "b/0"]


def test_streams_go_on_storing(spark, dimensions, tmp_path, put, monkeypatch):
    put("a", "2024-03-01T10:00:00")
    put("b", "2024-03-02T10:00:00")
    really = merged.write

    def meanwhile(*arguments):
        put("c", "2024-03-03T10:00:00")
        return really(*arguments)

    monkeypatch.setattr(merged, "write", meanwhile)
    assert gatewire.compact(spark, str(tmp_path), "authn") == {MARCH: 2}
    assert ids(spark, tmp_path) == ["a/0", "b/0", "c/0"]


def test_retention_and_further_tries_of_joined_months(spark, dimensions, tmp_path, put, open_months):
    root = str(tmp_path)
    put("a", "2024-03-01T10:00:00", "2024-05-01T10:00:00")
    put("b", "2024-03-02T10:00:00", "2024-04-02T10:00:00")
    gatewire.compact(spark, root, "authn", at_least=1, grace=0)
    later = partitions.create_missing(open_months, partitions.plan_partitions(partitions.on_day(spark, dt.date(2024, 5, 1))))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(folders, "create_whole", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            gatewire.reprocess(spark, root, "authn", dimensions, later)
    gatewire.compact(spark, root, "authn", at_least=1, grace=0)
    gatewire.reprocess(spark, root, "authn", dimensions, later)
    assert ids(spark, tmp_path) == ["a/0", "a/1", "b/0", "b/1"]
    tables.drop_months(spark, f"{root}/verdict=accepted", [dt.date(2024, 3, 1)])
    assert ids(spark, tmp_path) == ["a/1", "b/1"]
    gatewire.compact(spark, root, "authn", at_least=1, grace=0)
    assert MARCH not in (merged.state(spark, root) or {}) and ids(spark, tmp_path) == ["a/1", "b/1"]


def test_large_months_become_several_files_in_order(spark, tmp_path, put):
    for n in range(4):
        put(f"b{n}", *[f"2024-03-{d:02d}T{n:02d}:00:00" for d in range(1, 29)])
    size = sum(folders.size(spark, path) for path in batches.paths(spark, str(tmp_path), "accepted"))
    gatewire.compact(spark, str(tmp_path), "authn", file_bytes=size // 4, grace=0)
    gatewire.compact(spark, str(tmp_path), "authn", grace=0)
    there = {path.rsplit("/", 1)[1] for path in stored(tmp_path, MARCH)}
    rows = zones.noted(spark, str(tmp_path)).orderBy("first_created").collect()
    notes = [(r.first_created, r.last_created) for r in rows if r.file in there]
    assert len(notes) == 4 and all(one[1] <= two[0] for one, two in zip(notes, notes[1:]))


def test_variants_survive_joining(spark, dimensions, tmp_path):
    months = partitions.plan_partitions(partitions.on_day(spark, dt.date(2018, 5, 1)))
    for n in range(2):
        messages = spark.createDataFrame([(n, text(AUTHZ).encode())], "msg_id long, body binary")
        gatewire.write_checked(check_authz(messages, dimensions, months), str(tmp_path), "authz", f"b{n}")
    one = gatewire.read_accepted(spark, str(tmp_path), "authz").select(F.to_json("contextrequestjson")).collect()
    gatewire.compact(spark, str(tmp_path), "authz")
    assert gatewire.read_accepted(spark, str(tmp_path), "authz").select(F.to_json("contextrequestjson")).collect() == one


HOUR = dt.datetime(2024, 3, 2, 10), dt.datetime(2024, 3, 2, 11)


def test_an_hour_reads_only_files_that_may_have_some_of_it(spark, tmp_path, put):
    root = str(tmp_path)
    for n in range(1, 6):
        put(f"b{n}", f"2024-03-0{n}T10:00:00", f"2024-03-0{n}T10:59:59.999999", f"2024-03-0{n}T11:00:00")
    put("wide", "2024-03-01T00:00:00", "2024-03-31T00:00:00")
    rows = gatewire.read_accepted_range(spark, root, "authn", *HOUR)
    assert sorted(r.sessionid for r in rows.collect()) == ["b2/0", "b2/1"]
    assert sorted(batches.name_of(path) for path in rows.inputFiles()) == ["b2", "wide"]
    # files that nothing was noted of are read
    for folder in folders.matching(spark, f"{root}/_zones/*"):
        folders.delete(spark, folder)
    rows = gatewire.read_accepted_range(spark, root, "authn", *HOUR)
    assert len(rows.inputFiles()) == 6 and ids(spark, tmp_path, *HOUR) == ["b2/0", "b2/1"]
    # joining notes what is missing, and cuts by time
    gatewire.compact(spark, root, "authn", file_bytes=1500, grace=0)
    gatewire.compact(spark, root, "authn", grace=0)
    rows = gatewire.read_accepted_range(spark, root, "authn", *HOUR)
    assert ids(spark, tmp_path, *HOUR) == ["b2/0", "b2/1"] and len(rows.inputFiles()) < len(stored(tmp_path, MARCH))


def test_borders_of_ranges(spark, tmp_path, put):
    put("a", "2024-02-29T23:59:59.999999", "2024-03-01T00:00:00", "2024-03-31T23:59:59.999999", "2024-04-01T00:00:00")
    day = lambda *of: dt.datetime(*of)
    assert ids(spark, tmp_path, day(2024, 3, 1), day(2024, 4, 1)) == ["a/1", "a/2"]
    assert ids(spark, tmp_path, day(2024, 3, 1, 0, 0, 1), day(2024, 4, 1, 0, 0, 1)) == ["a/2", "a/3"]
    assert ids(spark, tmp_path, day(2024, 1, 1), day(2025, 1, 1)) == ["a/0", "a/1", "a/2", "a/3"]
    assert ids(spark, tmp_path, day(2024, 3, 1), day(2024, 3, 1)) == []


def test_noted_statistics_are_those_of_the_events(spark, dimensions, tmp_path, put, open_months):
    root = str(tmp_path)

    def same():
        events = readouts.with_partition(gatewire.read_accepted(spark, root, "authn").drop("created_month"), "authn")
        wanted = readouts.partition_stats(events, open_months)
        got = gatewire.stored_stats(spark, {"authn": root}, open_months)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        return {r.start_date.month: r.n_rows for r in got.where("schema_name = 'authentication'").collect()}

    assert same() == {2: 0, 3: 0, 4: 0}
    put("a", "2024-03-01T10:00:00", "2024-04-02T10:00:00", "2024-03-05T10:00:00")
    put("b", "2024-03-03T10:00:00")
    assert same() == {2: 0, 3: 3, 4: 1}
    put("a", "2024-03-02T10:00:00")  # a replay
    assert same() == {2: 0, 3: 2, 4: 0}
    gatewire.compact(spark, root, "authn", at_least=1, grace=0)
    assert same() == {2: 0, 3: 2, 4: 0}
    put("b", "2024-03-09T10:00:00", "2024-03-08T10:00:00")  # and one of a joined batch
    assert same() == {2: 0, 3: 3, 4: 0}
    tables.drop_months(spark, f"{root}/verdict=accepted", [dt.date(2024, 3, 1)])
    assert same() == {2: 0, 3: 0, 4: 0}


def test_statistics_read_no_events(spark, tmp_path, put, open_months):
    put("a", "2024-03-01T10:00:00")
    got = gatewire.stored_stats(spark, {"authn": str(tmp_path)}, open_months)
    assert all("_zones" in path for path in got.inputFiles())


def test_notes_do_not_pile_up(spark, tmp_path, put):
    for n in range(4):
        put(f"b{n}", f"2024-03-0{n + 1}T10:00:00")
        gatewire.compact(spark, str(tmp_path), "authn", grace=0)
    assert len(folders.matching(spark, f"{tmp_path}/_zones/*")) <= 4
    assert {r.ingest_batch[:2] for r in zones.noted(spark, str(tmp_path)).collect()} >= {"~m"}
    assert sum(r.n_rows for r in zones.stored_stats(spark, str(tmp_path)).collect()) == 4


def test_nothing_to_join(spark, tmp_path):
    assert gatewire.compact(spark, f"{tmp_path}/none", "authn") == {}
    assert compaction.GRACE > 0
