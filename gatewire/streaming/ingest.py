"""Continuous ingest: the batch plans inside ``foreachBatch``."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gatewire.plans.ingest import CHECKS
from gatewire.sources.tables import write_checked


def start_ingest(
    messages: DataFrame,
    kind: str,
    root: str,
    checkpoint: str,
    dimensions: Callable[[], dict[str, DataFrame]],
    catalog: Callable[[], DataFrame],
    name: str = "ingest",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Read messages for ever (or ``trigger={"availableNow": True}``) into the tables below ``root``.

    Which months are open is looked up anew for each micro-batch: late and
    early events are taken as long as their partition exists, whatever the
    newest event time seen so far, so there is no watermark.  Repeated messages
    are stored repeatedly; only the replay of a micro-batch isn't.

    A micro-batch is one write job and holds no state and no cache, so lost
    executors just have their tasks run again.  It is stored under the id that
    its query keeps in the checkpoint, so streams with different checkpoints
    never replace each other's rows, whatever their names.
    """
    replay_possible = [True]
    query_id: list[str] = []
    known = threading.Event()

    def store(batch: DataFrame, batch_id: int) -> None:
        if not known.wait(600):
            raise RuntimeError("the query did not start")
        label = f"{name}-{query_id[0]}-{batch_id:012d}"
        # Only the first batch after a start can have been tried before.
        write_checked(
            CHECKS[kind](batch, dimensions(), catalog()), root, kind, label, tried_before=bool(replay_possible)
        )
        replay_possible.clear()

    writer = messages.writeStream.queryName(name).foreachBatch(store).option("checkpointLocation", checkpoint)
    query = writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()
    query_id.append(str(query.id))
    known.set()
    return query
