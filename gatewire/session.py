"""Session settings the transforms rely on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Needed for right results: UTC month boundaries, last-one-wins for repeated JSON keys.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # matters only to schemas with column ids
    "spark.sql.parquet.fieldId.read.enabled": "true",
}

# The JVM leaves methods beyond 8000 bytes of bytecode to its interpreter, and the parsing of wide
# documents makes long ones; with this limit Spark generates them in pieces instead.
EXECUTION_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # An ingest task meets few months, so it keeps a file open for each instead of sorting its rows;
    # one that meets more than this sorts after all.
    "spark.sql.maxConcurrentOutputFileWriters": "6",
    # An access request is stored whole, beside the typed columns that are read of it; cutting it into
    # columns of its own as well would cost an ingest more than a tenth of its time.
    "spark.sql.variant.inferShreddingSchema": "false",
}

# Defaults for a session built here; a cluster's own settings win over them.
TUNING_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app_name: str = "gatewire", master: str | None = None, **settings: str) -> SparkSession:
    """Create or get a session. Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in TUNING_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings that the transforms rely on onto an existing session."""
    for key, value in (SEMANTIC_SETTINGS | EXECUTION_SETTINGS).items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the place every executor can reach.

    Only a local session, where driver and tasks share one machine, may fall
    back to a temporary folder.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/gatewire/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"gatewire-{label}-")
