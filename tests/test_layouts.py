"""Typed columns beside the request, generations by column ids, and the queue."""

import datetime as dt

import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

import gatewire
from gatewire.operators import partitions, readouts
from gatewire.operators.shred import shredded
from gatewire.plans.ingest import check_authz
from gatewire.schemas import FACT_COLUMNS_V0
from gatewire.sources import batches, folders, queue
from gatewire.sources.generations import Layout, Registry, append_generation, read_generation

from samples import AUTHN, AUTHZ, CONTEXT, text

MONTH = dt.date(2018, 5, 1)


@pytest.fixture
def authz_root(spark, dimensions, tmp_path):
    """Requests that flatten in all ways, stored with typed columns and, as before there were any, without."""
    odd = [CONTEXT, {}, {"Attributes": []}, {"Attributes": [{"Category": "c"}]}, {"Attributes": [{"Category": "c", "Attributes": []}]}]
    odd += [{"ReturnPolicyIdList": "perhaps", "Attributes": [{"Category": "c"}]}, {"Attributes": "none"}]
    odd += [{"Attributes": [{"Category": "c", "Attributes": [{"AttributeId": "a", "AttributeValues": [{"Value": 5, "DataType": None}]}]}]}]
    rows = [(i, text(AUTHZ, SessionId=f"s{i}", ContextRequestJson=context).encode()) for i, context in enumerate(odd)]
    messages = spark.createDataFrame(rows, "msg_id long, body binary").coalesce(1)
    months = partitions.plan_partitions(partitions.on_day(spark, MONTH))
    checked = check_authz(messages, dimensions, months)
    root = f"{tmp_path}/authz"
    gatewire.write_checked(checked, root, "authz", "new")
    old = gatewire.accepted(checked, "authz").withColumn("sessionid", F.concat(F.lit("old-"), "sessionid"))
    old.write.parquet(f"{root}/verdict=accepted/created_month={MONTH}/ingest_batch=old")
    return root


def test_typed_columns_flatten_as_the_request_does(spark, authz_root):
    def printed(rows):
        return sorted(map(str, rows.collect()))

    keep = ("sessionid", "operation")
    wanted = printed(readouts.flatten_context(gatewire.read_accepted(spark, authz_root, "authz"), keep))
    assert len(wanted) > 10 and printed(gatewire.read_context(spark, authz_root, keep)) == wanted
    gatewire.compact(spark, authz_root, "authz", grace=0)
    assert gatewire.compact(spark, authz_root, "authz", grace=0) == {}
    assert printed(gatewire.read_context(spark, authz_root, keep)) == wanted
    joined = spark.read.parquet(*batches.paths(spark, authz_root, "accepted"))
    assert joined.where("contextshredded").count() == joined.count() == 2 * gatewire.read_accepted(spark, authz_root, "authz").where("sessionid LIKE 'old%'").count()


def test_flattening_reads_typed_columns_alone(spark, authz_root):
    plan = gatewire.read_context(spark, authz_root, ("sessionid",))._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert len(read) == 2 and sum("contextattributes" in schema for schema in read) == 1
    assert not any("contextattributes" in schema and "variant" in schema for schema in read)
    assert all("contextshredded" in line.split("PushedFilters: ")[1] for line in plan.splitlines() if "PushedFilters" in line)
    assert "contextrequestjson" not in str(shredded("authn")) and shredded("authn") == {}


def instants(spark, *rows, columns):
    made = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], columns)
    return made.withColumn("created", F.lit("2024-03-05 10:00:00").cast("timestamp"))


def test_three_generations_in_one_folder(spark, tmp_path):
    """A column is added, one renamed, one widened, one dropped, and its name taken by another."""
    path, table = f"{tmp_path}/t", Registry({"id": "int", "created": "timestamp", "ip": "string", "party": "int"})
    append_generation(instants(spark, ("a", 1), ("b", 2), columns="id int, ip string, party int"), path, table.newest)
    table.with_column("uuid", "string")
    append_generation(instants(spark, ("c", 3, "u"), columns="id int, ip string, party int, uuid string"), path, table.newest)
    table.add(table.newest.renamed(ip="address").widened(party="bigint"))
    append_generation(instants(spark, ("d", 1 << 40, "v"), columns="id int, address string, party long, uuid string"), path, table.newest)
    rows = read_generation(spark, path, table.newest)
    assert rows.columns == ["id", "created", "address", "party", "uuid", "created_month"]
    got = sorted(map(tuple, rows.select("address", "party", "uuid").collect()), key=str)
    assert got == [("a", 1, None), ("b", 2, None), ("c", 3, "u"), ("d", 1 << 40, "v")]
    table.add(table.newest.without("address"))
    table.with_column("ip", "string")
    append_generation(instants(spark, (5, "w", "new"), columns="id int, party long, uuid string, ip string"), path, table.newest)
    got = read_generation(spark, path, table.newest).select("ip", "party").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1), (None, 2), (None, 3), (None, 1 << 40), ("new", 5)], key=str)
    # an older layout still reads what it knows of newer files
    got = read_generation(spark, path, table.layouts[1]).select("ip").collect()
    assert sorted(str(r.ip) for r in got) == ["None", "a", "b", "c", "d"]


def test_filters_reach_renamed_columns(spark, tmp_path):
    table = Registry({"id": "int", "created": "timestamp", "ip": "string"})
    append_generation(instants(spark, ("a",), ("b",), columns="id int, ip string"), str(tmp_path), table.newest)
    table.add(table.newest.renamed(ip="address"))
    found = read_generation(spark, str(tmp_path), table.newest).where("address = 'b'").select("address")
    assert [r.address for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(address,b)" in plan and "id:int" not in plan.split("ReadSchema")[1]


def test_files_without_ids_are_read_by_name(spark, tmp_path):
    table = Registry({"id": "int", "created": "timestamp", "ip": "string"})
    gatewire.append_events(instants(spark, ("a",), columns="id int, ip string"), str(tmp_path))
    table.add(table.newest.renamed(ip="address").widened(id="bigint"))
    table.with_column("uuid", "string")
    rows = read_generation(spark, str(tmp_path), table.newest, by_name=table.layouts[0])
    assert rows.columns == ["id", "created", "address", "uuid", "created_month"]
    assert [(r.id, r.address, r.uuid) for r in rows.collect()] == [(0, "a", None)]


def test_layouts_that_make_no_sense():
    table = Registry(FACT_COLUMNS_V0["authn"])
    for wrong in (
        lambda: table.newest.renamed(nothing="x"),
        lambda: table.newest.widened(nothing="x"),
        lambda: table.newest.without("nothing"),
        lambda: table.add(table.newest.renamed(userid="SessionId")),
        lambda: table.with_column("USERID", "int"),
        lambda: table.add(Layout({99: ("x", "int")})),
    ):
        with pytest.raises(ValueError):
            wrong()
    assert len(table.layouts) == 1


class Queue:
    """A queue and a stream from it into tables."""

    def __init__(self, spark, dimensions, folder):
        self.spark, self.dimensions, self.folder = spark, dimensions, folder
        gatewire.save_catalog(partitions.plan_partitions(partitions.on_day(spark, dt.date(2023, 9, 1))), f"{folder}/catalog")

    def send(self, *names):
        rows = [(i, text(AUTHN, SessionId=name).encode()) for i, name in enumerate(names)]
        return gatewire.append_segment(f"{self.folder}/queue", rows, rows=2)

    def run(self, **options):
        messages = gatewire.read_queue(self.spark, f"{self.folder}/queue", "authn", streaming=True, **options)
        gatewire.start_ingest(
            messages,
            "authn",
            f"{self.folder}/out",
            f"{self.folder}/state",
            lambda: self.dimensions,
            lambda: gatewire.load_catalog(self.spark, f"{self.folder}/catalog"),
            trigger={"availableNow": True},
        ).awaitTermination()

    def stored(self):
        return sorted(r.sessionid for r in gatewire.read_accepted(self.spark, f"{self.folder}/out", "authn").collect())


def test_queue_restart_repeats_and_loses_nothing(spark, dimensions, tmp_path):
    source = Queue(spark, dimensions, tmp_path)
    assert [source.send("a", "b", "c"), source.send("d")] == [[0], [1]]
    source.run()
    assert source.stored() == ["a", "b", "c", "d"]
    source.send("e", "e")
    source.run()
    assert source.stored() == ["a", "b", "c", "d", "e", "e"]
    # the last batch was stored, but the stream died before noting it
    for note in (tmp_path / "state" / "commits").iterdir():
        if note.name in ("1", ".1.crc"):
            note.unlink()
    source.send("f")
    source.run()  # makes the unfinished batch again
    assert source.stored() == ["a", "b", "c", "d", "e", "e"]
    source.run()
    assert source.stored() == ["a", "b", "c", "d", "e", "e", "f"]
    assert len(list((tmp_path / "queue").glob("*.segment"))) == 4


def test_queue_acknowledges_what_is_committed(spark, dimensions, tmp_path):
    source = Queue(spark, dimensions, tmp_path)
    for n in range(3):
        source.send(f"{n}")
    source.run(acknowledge=True)
    source.send("x")
    source.run(acknowledge=True)
    assert source.stored() == ["0", "1", "2", "x"]
    # what a stream has committed goes when it commits the next batch or later; nothing that it hasn't
    left = [int(path.name[:12]) for path in (tmp_path / "queue").glob("*.segment")]
    assert 0 not in left and queue._numbers(f"{tmp_path}/queue")[-1:] in ([], [3])


def test_queue_as_a_batch(spark, tmp_path):
    assert gatewire.read_queue(spark, f"{tmp_path}/q", "authz").count() == 0
    gatewire.append_segment(f"file://{tmp_path}/q", [(1, b"\xff"), (None, b"")])
    (tmp_path / "q" / ".draft").write_bytes(b"unfinished")
    rows = gatewire.read_queue(spark, f"{tmp_path}/q", "authz").collect()
    assert [(r.msg_id, bytes(r.body)) for r in rows] == [(1, b"\xff"), (None, b"")]
    assert folders.exists(spark, f"{tmp_path}/q/000000000000.segment")
    assert gatewire.append_segment(f"{tmp_path}/q", []) == []


def test_many_tasks_send_and_several_triggers_read(spark, dimensions, tmp_path):
    source = Queue(spark, dimensions, tmp_path)
    bodies = [(i, text(AUTHN, SessionId=f"{i:03d}")) for i in range(100)]
    messages = spark.createDataFrame(bodies, "msg_id long, body string").repartition(4, "msg_id")
    assert gatewire.send(messages, f"{tmp_path}/queue") == [0, 1, 2, 3]
    assert gatewire.send(messages.where("msg_id < 0"), f"{tmp_path}/queue") == []
    for _ in range(2):
        source.run(segments_per_trigger=3)
    assert source.stored() == [f"{i:03d}" for i in range(100)]
    assert not [p for p in (tmp_path / "queue").iterdir() if p.name.startswith(".")]


def test_requests_are_not_cut_into_columns_of_their_own_as_well(spark, authz_root):
    [path] = batches.paths(spark, authz_root, "accepted", "new")
    files = [ParquetFile(found.removeprefix("file:")) for found in folders.matching(spark, f"{path}/*.parquet")]
    held = {column.path for file in files for column in file.schema if column.path.startswith("contextrequestjson.")}
    assert held == {"contextrequestjson.metadata", "contextrequestjson.value"}
