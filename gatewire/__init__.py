"""Ingest, checking, storage and retention of security event messages on Spark."""

from gatewire.operators.envelope import decode
from gatewire.operators.lookups import decode_names, insert_if_absent
from gatewire.operators.parse import authn_to_json, conform, parse_authn, parse_authz
from gatewire.operators.readouts import flatten_context, partition_stats, time_range, union_generations
from gatewire.operators.shred import flatten_stored
from gatewire.operators.validate import split, validate
from gatewire.plans.compact import compact
from gatewire.plans.ingest import accepted, check_authn, check_authz, check_authz_documents, rejected
from gatewire.plans.maintenance import maintain, run_maintenance
from gatewire.plans.reprocess import reprocess
from gatewire.session import build_session, configure
from gatewire.sources.catalog import load_catalog, save_catalog, update_catalog
from gatewire.sources.dimensions import current_dimensions, load_dimensions, save_dimensions, seed_dimensions
from gatewire.sources.generations import append_generation, read_generation
from gatewire.sources.messages import as_messages, read_messages
from gatewire.sources.queue import append_segment, read_queue, send
from gatewire.sources.tables import (
    append_events,
    drop_months,
    read_accepted,
    read_accepted_range,
    read_context,
    read_events,
    read_quarantine,
    read_range,
    read_resting,
    stored_stats,
    rewrite_by_year,
    write_checked,
)
from gatewire.streaming.ingest import start_ingest

__all__ = [name for name in dir() if not name.startswith("_")]
