"""Required-field, range, length and reference rules, all collected per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewire import vocabulary as v
from gatewire.functions.json_fields import is_json_object
from gatewire.functions.problems import NO_PROBLEMS, add_problems, errors_map, problem
from gatewire.operators.lookups import REFERENCES, flag_unroutable, flag_violators
from gatewire.operators.parse import stored_decision
from gatewire.vocabulary import SCHEMA_NAMES


def created_missing() -> Column:
    return F.col("created").isNull()


def operation_missing() -> Column:
    return F.coalesce(F.col("operation"), F.lit("")) == ""


def context_not_object() -> Column:
    context = F.col("contextrequestjson")
    return context.isNull() | ~is_json_object(context)


def decision_missing() -> Column:
    return F.col("decision").isNull()


def decision_out_of_range() -> Column:
    """On wire numbers; the stored one has to be between 1 and 4."""
    wire = F.col("decision")
    return wire.isNotNull() & ~F.coalesce(stored_decision(wire).between(1, 4), F.lit(False))


def uuid_too_long() -> Column:
    return F.char_length("subject_party_uuid") > v.SUBJECT_PARTY_UUID_MAX_CHARS


def _not_yet(code: str) -> Column:
    """A field that could not be read is reported once, not as missing as well."""
    return ~F.contains(F.col("problems"), F.lit(code))


def _row_rules(kind: str) -> list[Column]:
    missing = problem("created_missing", {"Created": created_missing() & _not_yet("bad_created")})
    if kind == "authn":
        return [missing]
    return [
        missing,
        # An unreadable text is NULL too, so name the field that was unreadable.
        problem("operation_missing", {"Operation": operation_missing() & _not_yet("Operation")}),
        problem("context_not_object", {"ContextRequestJson": context_not_object()}),
        problem("decision_missing", {"Decision": decision_missing() & _not_yet("bad_enum")}),
        problem("decision_range", {"Decision": decision_out_of_range()}),
        problem("uuid_too_long", {"SubjectPartyUuid": uuid_too_long()}),
    ]


def validate(events: DataFrame, kind: str, dimensions: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """Replace ``problems`` by ``errors`` (map of code to fields) and ``is_valid``.

    Expects the columns of ``parse_authn`` / ``parse_authz``.  A message whose
    envelope or document is unreadable has no fields to check and keeps its
    single reason.
    """
    if "problems" not in events.columns:
        events = events.withColumn("problems", F.lit(NO_PROBLEMS))
    refs = REFERENCES[kind]
    if kind == "authz":
        # The check is on the stored number; one out of range is reported as such.
        events = events.withColumn("_wire", F.col("decision")).withColumn(
            "decision", F.when(~decision_out_of_range(), stored_decision(F.col("decision")))
        )
    events = flag_unroutable(flag_violators(events, refs, dimensions), catalog, SCHEMA_NAMES[kind])
    if kind == "authz":
        events = events.withColumn("decision", F.col("_wire")).drop("_wire")
    unreadable = F.col("problems").rlike("^(not_object|bad_base64|too_short_decoded|unsupported_version|bad_brotli):")
    readable = (F.col("problems") == NO_PROBLEMS) | ~unreadable
    rules = [
        *_row_rules(kind),
        *[problem(ref.code, {ref.column: F.col(ref.code)}) for ref in refs],
        problem("no_partition", {"Created": F.col("no_partition")}),
    ]
    all_problems = F.when(readable, add_problems(F.col("problems"), *rules)).otherwise(F.col("problems"))
    return (
        events.withColumn("problems", all_problems)
        .drop(*[ref.code for ref in refs], "no_partition")
        .withColumns({"errors": errors_map(F.col("problems")), "is_valid": F.col("problems") == NO_PROBLEMS})
        .drop("problems")
    )


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused rows of a validated DataFrame."""
    return checked.where("is_valid"), checked.where("NOT is_valid")
