"""Continuous ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import gatewire
from gatewire.operators import partitions
from gatewire.plans.ingest import check_authz
from gatewire.sources import folders

from samples import AUTHN, AUTHZ, b64, text, v01


def plan(spark, *days):
    frames = [partitions.plan_partitions(partitions.on_day(spark, day)) for day in days]
    result = frames[0]
    for frame in frames[1:]:
        result = partitions.create_missing(result, frame)
    return result


class Ingest:
    """A stream over Parquet files, run to the end of what there is."""

    def __init__(self, spark, kind, folder, dimensions):
        self.spark, self.kind, self.folder, self.dimensions = spark, kind, folder, dimensions

    def put(self, messages):
        messages.write.mode("append").parquet(f"{self.folder}/in")

    def run(self, files_per_batch="1000"):
        stream = gatewire.read_messages(
            self.spark, f"{self.folder}/in", self.kind, streaming=True, maxFilesPerTrigger=files_per_batch
        )
        query = gatewire.start_ingest(
            stream,
            self.kind,
            f"{self.folder}/out",
            f"{self.folder}/state",
            lambda: self.dimensions,
            lambda: gatewire.load_catalog(self.spark, f"{self.folder}/catalog"),
            trigger={"availableNow": True},
        )
        query.awaitTermination()

    def accepted(self):
        return gatewire.read_accepted(self.spark, f"{self.folder}/out", self.kind)

    def refused(self):
        return gatewire.read_quarantine(self.spark, f"{self.folder}/out")


def test_stream_equals_batch(spark, dimensions, tmp_path):
    document = text(AUTHZ).encode()
    bodies = [document, b64(document), v01(document), b64(v01(document)), b"99abc", b"x", b" {}", b"01zz"]
    messages = spark.createDataFrame(list(enumerate(bodies)) * 3, "msg_id long, body binary").repartition(3)
    ingest = Ingest(spark, "authz", tmp_path, dimensions)
    gatewire.save_catalog(plan(spark, dt.date(2018, 5, 1)), f"{tmp_path}/catalog")
    ingest.put(messages)
    ingest.run(files_per_batch="1")
    checked = check_authz(messages, dimensions, plan(spark, dt.date(2018, 5, 1)))
    expected = gatewire.accepted(checked, "authz")
    got = ingest.accepted().select(*expected.columns)
    assert got.count() == 12
    printed = {"contextrequestjson": F.to_json("contextrequestjson")}
    rows, wanted = (sorted(map(str, frame.withColumns(printed).collect())) for frame in (got, expected))
    assert rows == wanted
    refused = sorted((r.msg_id, str(r.errors)) for r in ingest.refused().collect())
    assert refused == sorted((r.msg_id, str(r.errors)) for r in gatewire.rejected(checked).collect())
    assert len(folders.matching(spark, f"{tmp_path}/out/verdict=accepted/created_month=*/ingest_batch=*")) > 1


def test_restart_reads_only_what_is_new_and_repeats_are_kept(spark, dimensions, tmp_path):
    messages = spark.createDataFrame([(1, text(AUTHN))], "msg_id long, body string")
    ingest = Ingest(spark, "authn", tmp_path, dimensions)
    gatewire.save_catalog(plan(spark, dt.date(2023, 9, 1)), f"{tmp_path}/catalog")
    ingest.put(messages)
    ingest.run()
    ingest.run()
    assert ingest.accepted().count() == 1
    ingest.put(messages)
    ingest.run()
    assert ingest.accepted().count() == 2


def test_replayed_batch_is_stored_once(spark, dimensions, tmp_path):
    ingest = Ingest(spark, "authn", tmp_path, dimensions)
    gatewire.save_catalog(plan(spark, dt.date(2023, 9, 1)), f"{tmp_path}/catalog")
    ingest.put(spark.createDataFrame([(1, text(AUTHN)), (2, "null")], "msg_id long, body string"))
    ingest.run()
    # The batch was stored, but the stream died before noting it; meanwhile the month was closed.
    for note in (tmp_path / "state" / "commits").iterdir():
        note.unlink()
    gatewire.save_catalog(plan(spark, dt.date(2030, 1, 1)), f"{tmp_path}/catalog")
    ingest.run()
    assert ingest.accepted().count() == 0
    assert sorted((r.msg_id, *r.errors) for r in ingest.refused().collect()) == [(1, "no_partition"), (2, "not_object")]


def test_months_open_and_close_between_batches(spark, dimensions, tmp_path):
    """Acceptance follows the list of partitions and not the newest event seen."""
    ingest = Ingest(spark, "authn", tmp_path, dimensions)

    def put(*days):
        rows = [(i, text(AUTHN, SessionId=day, Created=f"{day}T12:00:00Z")) for i, day in enumerate(days)]
        ingest.put(spark.createDataFrame(rows, "msg_id long, body string"))

    gatewire.save_catalog(plan(spark, dt.date(2023, 9, 1)), f"{tmp_path}/catalog")
    put("2023-10-31", "2023-08-01", "2023-07-31", "2023-11-01")
    ingest.run()
    assert sorted(r.sessionid for r in ingest.accepted().collect()) == ["2023-08-01", "2023-10-31"]
    assert ingest.refused().count() == 2
    gatewire.run_maintenance(spark, f"{tmp_path}/catalog", {}, dt.date(2023, 10, 1))
    put("2023-08-02", "2023-11-02", "2023-07-30")
    ingest.run()
    assert sorted(r.sessionid for r in ingest.accepted().collect()) == [
        "2023-08-01", "2023-08-02", "2023-10-31", "2023-11-02",
    ]
    assert ingest.refused().count() == 3


def test_text_and_file_sources(spark, tmp_path):
    spark.createDataFrame([("{}",), ("null",)], "v string").write.text(f"{tmp_path}/lines")
    lines = gatewire.read_messages(spark, f"{tmp_path}/lines", "authn", fmt="text")
    assert sorted(r.body for r in lines.collect()) == ["null", "{}"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "1.bin").write_bytes(b"01\xff")
    files = gatewire.read_messages(spark, f"{tmp_path}/files", "authz", fmt="binaryFile")
    assert [bytes(r.body) for r in files.collect()] == [b"01\xff"]
    topic = spark.createDataFrame([(b"{}", 7)], "value binary, offset long")
    assert gatewire.as_messages(topic, "authn", "value", "offset").first() == (7, "{}")


def test_streams_with_checkpoints_of_their_own_keep_each_others_events(spark, dimensions, tmp_path):
    """Neither a new checkpoint nor a second stream, under the same name, replaces what is stored."""
    gatewire.save_catalog(plan(spark, dt.date(2023, 9, 1)), f"{tmp_path}/catalog")
    for n, count in enumerate((5, 3)):
        ingest = Ingest(spark, "authn", tmp_path, dimensions)
        rows = [(i, text(AUTHN)) for i in range(count)]
        spark.createDataFrame(rows, "msg_id long, body string").write.parquet(f"{tmp_path}/in-{n}")
        query = gatewire.start_ingest(
            gatewire.read_messages(spark, f"{tmp_path}/in-{n}", "authn", streaming=True),
            "authn",
            f"{tmp_path}/out",
            f"{tmp_path}/state-{n}",
            lambda: dimensions,
            lambda: gatewire.load_catalog(spark, f"{tmp_path}/catalog"),
            trigger={"availableNow": True},
        )
        query.awaitTermination()
    assert ingest.accepted().count() == 8


@pytest.mark.parametrize("name", ["authn:eu", "authn-*"])
def test_streams_of_any_name_restart(spark, dimensions, tmp_path, name):
    """A restart looks for what the same stream stored, and for nothing else."""
    gatewire.save_catalog(plan(spark, dt.date(2023, 9, 1)), f"{tmp_path}/catalog")

    def run(label, state):
        gatewire.start_ingest(
            gatewire.read_messages(spark, f"{tmp_path}/in", "authn", streaming=True),
            "authn",
            f"{tmp_path}/out",
            f"{tmp_path}/{state}",
            lambda: dimensions,
            lambda: gatewire.load_catalog(spark, f"{tmp_path}/catalog"),
            name=label,
            trigger={"availableNow": True},
        ).awaitTermination()

    for n in range(2):
        spark.createDataFrame([(n, text(AUTHN)), (n, "null")], "msg_id long, body string").write.mode("append").parquet(f"{tmp_path}/in")
        run("authn-other", "other")
        run(name, "state")
    for note in (tmp_path / "state" / "commits").iterdir():
        if note.name in ("1", ".1.crc"):
            note.unlink()
    run(name, "state")
    assert gatewire.read_accepted(spark, f"{tmp_path}/out", "authn").count() == 4
    assert gatewire.read_quarantine(spark, f"{tmp_path}/out").count() == 4
