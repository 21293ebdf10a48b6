"""Versions that several jobs add to at once, and the list of partitions kept by them."""

import datetime as dt
import threading

import pytest

import gatewire
from gatewire.operators import partitions
from gatewire.plans import maintenance
from gatewire.sources import catalog, commits, folders


def together(*jobs):
    """Run jobs at the same time; re-raise what one of them raises."""
    failed = []

    def run(job):
        try:
            job()
        except BaseException as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(job,)) for job in jobs]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(120)
    if failed:
        raise failed[0]


def test_only_one_gets_a_number(spark, tmp_path):
    won = []
    barrier = threading.Barrier(12)

    def claim(n):
        barrier.wait()
        if folders.create_whole(spark, f"{tmp_path}/x/1", f"writer {n} " + "z" * 10_000):
            won.append(n)

    (tmp_path / "x").mkdir()
    together(*[lambda n=n: claim(n) for n in range(12)])
    assert len(won) == 1
    assert folders.read_text(spark, f"{tmp_path}/x/1") == f"writer {won[0]} " + "z" * 10_000
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["1"]


def test_the_way_of_other_storage(spark, tmp_path, monkeypatch):
    """What is done where there are no hard links, by a rename that replaces nothing."""
    monkeypatch.setattr(folders, "_link", folders._rename)
    assert folders.create_whole(spark, f"{tmp_path}/1", "a")
    assert not folders.create_whole(spark, f"{tmp_path}/1", "b")
    assert folders.read_text(spark, f"{tmp_path}/1") == "a"


def test_no_change_is_lost(spark, tmp_path):
    root = str(tmp_path)

    def add(n):
        commits.update(spark, root, lambda text: f"{text or ''}{n},")

    together(*[lambda n=n: [add(n) for _ in range(4)] for n in range(6)])
    version, text = commits.latest(spark, root)
    assert version == 24 and sorted(text.split(",")[:-1]) == sorted(str(n) for n in range(6) for _ in range(4))
    assert len(folders.matching(spark, f"{root}/_log/[0-9]*")) == commits.KEPT


def test_a_number_that_became_free_again_is_not_taken(spark, tmp_path):
    root = str(tmp_path)
    for n in range(commits.KEPT + 5):
        assert commits.claim(spark, root, n + 1, "x")
    assert not folders.exists(spark, f"{root}/_log/{2:012d}")
    assert not commits.claim(spark, root, 2, "late")
    assert commits.latest(spark, root) == (commits.KEPT + 5, "x")


def test_leaving_things_as_they_are_adds_no_version(spark, tmp_path):
    assert commits.update(spark, str(tmp_path), lambda text: None) is None
    assert commits.latest(spark, str(tmp_path)) == (0, None)


def names(spark, root):
    return sorted({row.name for row in gatewire.load_catalog(spark, root).collect()})


def test_maintenance_runs_side_by_side_keep_each_others_partitions(spark, tmp_path, monkeypatch):
    """Both runs read the same list before either writes."""
    root = f"{tmp_path}/catalog"
    days = dt.date(2024, 1, 5), dt.date(2024, 7, 5)
    both_have_read, calls = threading.Barrier(2), []

    def maintain(present, as_of, *more, really=maintenance.maintain):
        calls.append(as_of)
        if calls.count(as_of) == 1:
            both_have_read.wait(60)
        return really(present, as_of, *more)

    monkeypatch.setattr(maintenance, "maintain", maintain)
    together(*[lambda day=day: gatewire.run_maintenance(spark, root, {}, day) for day in days])
    assert names(spark, root) == [f"eventlogv1_y{y}m{m:02d}" for y, m in ((2023, 12), (2024, 1), (2024, 2), (2024, 6), (2024, 7), (2024, 8))]
    assert len(calls) == 3  # the second to finish had to start anew
    assert len(folders.matching(spark, f"{root}/list-*")) == 2


def test_a_run_that_drops_and_one_that_creates(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/catalog"
    gatewire.run_maintenance(spark, root, {}, dt.date(2023, 1, 1))
    meanwhile = []

    def between(catalog_root, change, really=catalog.update_catalog):
        def slow(present):
            rows = change(present)
            if not meanwhile:
                meanwhile.append(1)
                really(spark, root, lambda p: maintenance.maintain(p, dt.date(2024, 9, 1)))
            return rows

        return really(spark, catalog_root, slow)

    monkeypatch.setattr(maintenance, "update_catalog", lambda _, r, change: between(r, change))
    gatewire.run_maintenance(spark, root, {}, dt.date(2024, 5, 1), enabled=True, retention_months=2)
    assert names(spark, root) == [f"eventlogv1_y2024m{m:02d}" for m in (4, 5, 6, 8, 9, 10)]


def test_a_job_that_dies_leaves_the_list(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/catalog"
    gatewire.run_maintenance(spark, root, {}, dt.date(2024, 1, 1))
    before = names(spark, root)
    with monkeypatch.context() as patch:
        patch.setattr(commits, "claim", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            gatewire.run_maintenance(spark, root, {}, dt.date(2025, 1, 1))
    assert names(spark, root) == before
    gatewire.run_maintenance(spark, root, {}, dt.date(2025, 1, 1))
    assert len(names(spark, root)) == 6


def test_lists_from_before_there_was_a_log(spark, tmp_path):
    plan = partitions.plan_partitions(partitions.on_day(spark, dt.date(2024, 1, 1)))
    plan.write.parquet(f"{tmp_path}/version=00000003-ab")
    folders.mark(spark, f"{tmp_path}/version=00000003-ab/_finished")
    assert len(names(spark, str(tmp_path))) == 3
    gatewire.run_maintenance(spark, str(tmp_path), {}, dt.date(2024, 6, 1))
    assert len(names(spark, str(tmp_path))) == 6
