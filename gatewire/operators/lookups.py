"""Reference checks against, and decoding through, the small lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Reference:
    """A column of an event table that points into a lookup table."""

    column: str
    dimension: str
    code: str
    label: str


REFERENCES = {
    "authn": (
        Reference("eventtypeid", "authenticationeventtype", "fk_eventtype", "eventtype"),
        Reference("authenticationlevelid", "authenticationlevel", "fk_level", "authenticationlevel"),
        Reference("authenticationmethodid", "authenticationmethod", "fk_method", "authenticationmethod"),
    ),
    "authz": (Reference("decision", "decision", "fk_decision", "decision_name"),),
}


def reference(code: str) -> Reference:
    return next(ref for refs in REFERENCES.values() for ref in refs if ref.code == code)


# Lookup tables and the partition list come from VALUES or Parquet, so Catalyst
# knows their size: it broadcasts them while they are below
# spark.sql.autoBroadcastJoinThreshold and shuffles (with AQE splitting hot
# keys) should somebody let one grow beyond it.  Hence no broadcast hints here.
# Stored Parquet has no keys, so a lookup row that is there twice counts once.


def violators(events: DataFrame, ref: Reference, dimension: DataFrame) -> DataFrame:
    """Events whose id is missing from the lookup table; a NULL id refers to nothing and is fine."""
    ids = dimension.select(F.col("id").alias(ref.column))
    return events.where(F.col(ref.column).isNotNull()).join(ids, ref.column, "left_anti")


def flag_violators(events: DataFrame, refs: tuple[Reference, ...], dimensions: dict[str, DataFrame]) -> DataFrame:
    """Add one boolean per reference, named after its code; repeated lookup rows don't multiply events."""
    for ref in refs:
        known = f"_known_{ref.column}"
        ids = dimensions[ref.dimension].select(F.col("id").alias(known)).distinct()
        events = (
            events.join(ids, F.col(ref.column) == F.col(known), "left")
            .withColumn(ref.code, F.col(ref.column).isNotNull() & F.col(known).isNull())
            .drop(known)
        )
    return events


def decode_names(events: DataFrame, kind: str, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Add the name behind every lookup id; unknown and NULL ids get NULL, of several names the first counts."""
    for ref in REFERENCES[kind]:
        names = dimensions[ref.dimension].groupBy(F.col("id").alias("_id")).agg(F.min("name").alias(ref.label))
        events = events.join(names, F.col(ref.column) == F.col("_id"), "left").drop("_id")
    return events


def insert_if_absent(dimension: DataFrame, rows: DataFrame) -> DataFrame:
    """Lookup table plus those rows whose id it doesn't have yet; what is there wins.

    Of several new rows with one id the first by their other columns, in table order, is taken.
    """
    others = [c for c in dimension.columns if c != "id"]
    first = rows.groupBy("id").agg(F.min(F.struct(*others)).alias("_row")).select("id", "_row.*")
    return dimension.unionByName(first.join(dimension.select("id"), "id", "left_anti"))


def month_is_open(created: Column, catalog: DataFrame, schema_name: str) -> tuple[DataFrame, Column]:
    """Lookup side and join condition for "a partition of this schema exists for this instant".

    Partitions are whole calendar months, so ``start <= created < end`` equals
    a match on the first of the month, which joins by hash and not by range.
    """
    months = catalog.where(F.col("schema_name") == schema_name).select(F.col("start_date").alias("_open_month")).distinct()
    return months, F.trunc(created, "MM") == F.col("_open_month")


def flag_unroutable(events: DataFrame, catalog: DataFrame, schema_name: str) -> DataFrame:
    """Add boolean ``no_partition``: no existing partition would take the row."""
    months, matches = month_is_open(F.col("created"), catalog, schema_name)
    return (
        events.join(months, matches, "left")
        .withColumn("no_partition", F.col("created").isNotNull() & F.col("_open_month").isNull())
        .drop("_open_month")
    )


def route(events: DataFrame, catalog: DataFrame, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Split into events that fit an existing partition and those that don't."""
    months, matches = month_is_open(F.col("created"), catalog, schema_name)
    return events.join(months, matches, "left_semi"), events.join(months, matches, "left_anti")
