"""A message queue in a folder, as a source of batches and streams.

Senders append segments: numbered files that are there whole or not at all and never
change.  The position in the queue is the number of the next segment, which a stream keeps
in its checkpoint; a batch that was cut short is read again from the same segments after a restart.
With ``acknowledge`` segments go once the batch that read them is committed, as
messages of a queue do, otherwise they stay for other readers.

Segments are Arrow streams with ``msg_id`` and ``body``.  Each is a task of its own, which passes
it on record batch by record batch.  Any storage that pyarrow reaches will do for the folder.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = pa.schema([("msg_id", pa.int64()), ("body", pa.binary())])
SUFFIX = ".segment"

# What is defined here travels to the workers by value, which spares a cluster from installing this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _storage(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _numbers(folder: str) -> list[int]:
    store, path = _storage(folder)
    names = [info.base_name for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    return sorted(int(name.removesuffix(SUFFIX)) for name in names if name.endswith(SUFFIX) and not name.startswith("."))


def _segment(path: str, number: int) -> str:
    return f"{path}/{number:012d}{SUFFIX}"


def _draft(folder: str, batches) -> str | None:
    """Write record batches to a file that no reader sees yet; its path, or None without any row."""
    store, path = _storage(folder)
    draft, writer, sink = f"{path}/.{uuid.uuid4().hex}", None, None
    for batch in batches:
        if batch.num_rows:
            if writer is None:
                sink = store.open_output_stream(draft)
                writer = pa.ipc.new_stream(sink, SCHEMA)
            writer.write_table(pa.Table.from_batches([batch]).cast(SCHEMA))
    if writer is None:
        return None
    writer.close()
    sink.close()
    return draft


def _publish(folder: str, drafts: list[str]) -> list[int]:
    store, path = _storage(folder)
    first = max(_numbers(folder), default=-1) + 1
    for number, draft in enumerate(drafts, first):
        store.move(draft, _segment(path, number))
    return list(range(first, first + len(drafts)))


def append_segment(folder: str, messages: list[tuple[int | None, bytes]], rows: int = 1024) -> list[int]:
    """Add a segment with a few messages behind all others; returns its number. Senders must follow each other."""
    store, path = _storage(folder)
    store.create_dir(path, recursive=True)
    columns = zip(*messages) if messages else ([], [])
    table = pa.table([pa.array(column, kind) for column, kind in zip(columns, SCHEMA.types)], SCHEMA)
    draft = _draft(folder, table.to_batches(max_chunksize=rows))
    return _publish(folder, [draft] if draft else [])


def send(messages: DataFrame, folder: str) -> list[int]:
    """Add messages (``msg_id, body``), a segment for each task that has any; returns the numbers. Senders must follow each other.

    Tasks write drafts, of which those of tasks that were lost never become segments; the driver only gets names.
    """
    store, path = _storage(folder)
    store.create_dir(path, recursive=True)

    def write(batches):
        draft = _draft(folder, batches)
        yield pa.RecordBatch.from_pydict({"draft": pa.array([draft] if draft else [], pa.string())})

    rows = messages.select("msg_id", F.col("body").cast("binary").alias("body"))
    return _publish(folder, [row.draft for row in rows.mapInArrow(write, "draft string").collect()])


class Segment(InputPartition):
    def __init__(self, number: int | None):
        self.number = number


class _Reading:
    def __init__(self, folder: str):
        self.folder = folder

    def _tasks(self, numbers: list[int]) -> list[Segment]:
        return [Segment(number) for number in numbers] or [Segment(None)]

    def read(self, partition: Segment):
        if partition.number is None:
            return
        store, path = _storage(self.folder)
        with store.open_input_stream(_segment(path, partition.number)) as stream:
            yield from pa.ipc.open_stream(stream)


class QueueReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return self._tasks(_numbers(self.folder))


class QueueStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, folder: str, most: int, acknowledge: bool):
        super().__init__(folder)
        self.most, self.acknowledge = most, acknowledge
        self.given = 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """Behind all segments, or behind as many as are wanted after those that were given out last."""
        found = [number for number in _numbers(self.folder) if number >= self.given]
        if self.most:
            found = found[: self.most]
        self.given = found[-1] + 1 if found else self.given
        return {"next": self.given}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.given = max(self.given, end["next"])
        return self._tasks([number for number in _numbers(self.folder) if start["next"] <= number < end["next"]])

    def commit(self, end: dict) -> None:
        store, path = _storage(self.folder)
        for number in _numbers(self.folder) if self.acknowledge else []:
            if number < end["next"]:
                store.delete_file(_segment(path, number))


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gatewire_queue"

    def schema(self) -> str:
        return "msg_id bigint, body binary"

    def reader(self, schema) -> DataSourceReader:
        return QueueReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        options = self.options
        return QueueStreamReader(options["path"], int(options["segmentspertrigger"]), options["acknowledge"] == "true")


def read_queue(
    spark: SparkSession, folder: str, kind: str, streaming: bool = False, segments_per_trigger: int = 0, acknowledge: bool = False
) -> DataFrame:
    """Messages of kind ``authn`` (text) or ``authz`` (bytes) in a queue, as ``msg_id, body``."""
    spark.dataSource.register(QueueSource)
    reader = (spark.readStream if streaming else spark.read).format(QueueSource.name())
    found = reader.options(segmentsPerTrigger=str(segments_per_trigger), acknowledge=str(acknowledge).lower()).load(folder)
    return found.select("msg_id", F.col("body").cast("string" if kind == "authn" else "binary").alias("body"))
