"""From raw messages to checked events: one plan per kind, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewire.operators.envelope import decode
from gatewire.operators.parse import conform, parse_authn, parse_authz
from gatewire.operators.validate import validate
from gatewire.schemas import FACT_COLUMNS

CARRIED = ("msg_id", "body", "errors", "is_valid")


def check_authn(
    messages: DataFrame,
    dimensions: dict[str, DataFrame],
    catalog: DataFrame,
    strict: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``msg_id, body, errors, is_valid``, the columns to ``keep`` and the table columns, one row per message."""
    events = parse_authn(messages, "body", strict)
    return conform(validate(events, "authn", dimensions, catalog), "authn", CARRIED + keep)


def check_authz(
    messages: DataFrame, dimensions: dict[str, DataFrame], catalog: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """As ``check_authn``, for enveloped messages; those too short to be one are gone."""
    events = parse_authz(decode(messages, "body"), "json")
    return conform(validate(events, "authz", dimensions, catalog), "authz", CARRIED + keep)


def check_authz_documents(
    documents: DataFrame, dimensions: dict[str, DataFrame], catalog: DataFrame
) -> DataFrame:
    """Authorization events posted as JSON, without an envelope."""
    events = parse_authz(documents.withColumn("json", F.col("body").cast("string")), "json")
    return conform(validate(events, "authz", dimensions, catalog), "authz", CARRIED)


CHECKS = {"authn": check_authn, "authz": check_authz}


def accepted(checked: DataFrame, kind: str) -> DataFrame:
    """The table rows among checked messages."""
    return checked.where("is_valid").select(*FACT_COLUMNS[kind])


def rejected(checked: DataFrame) -> DataFrame:
    """The quarantine rows among checked messages."""
    return checked.where("NOT is_valid").select("msg_id", F.col("body").cast("binary").alias("body"), "errors")
