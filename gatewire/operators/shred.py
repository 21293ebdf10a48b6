"""Typed columns beside the stored access request, for the paths that are read again and again.

A VARIANT has to be read whole and taken apart for every query.  Events are therefore
stored with the attributes of their request as typed columns too, and whoever
flattens the request reads these alone.  Rows from before they existed still have the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewire.operators.readouts import flatten_attributes, request_attributes
from gatewire.schemas import SHREDDED_ATTRIBUTES, SHREDDED_COLUMNS, SHREDDED_MARK

CONTEXT = "contextrequestjson"


def typed_attributes(context: str = CONTEXT) -> Column:
    """The attributes of a request, as far as flattening reads them, exactly as it would read them."""

    def category(c: Column) -> Column:
        return F.struct(c["Category"].alias("Category"), c["Attributes"].alias("Attributes"))

    return F.transform(request_attributes(context), category)


def shredded(kind: str) -> dict[str, Column]:
    """Columns to store beside those of a table."""
    if not SHREDDED_COLUMNS[kind]:
        return {}
    return {SHREDDED_ATTRIBUTES: typed_attributes(), SHREDDED_MARK: F.lit(True)}


def flatten_stored(stored: DataFrame, keep: tuple[str, ...], context: str = CONTEXT) -> DataFrame:
    """``flatten_context`` of events that are stored with ``shredded`` columns, or partly so.

    Either half reads only its own columns; the mark lets Parquet skip whatever belongs to the other.
    """
    typed, marked = SHREDDED_ATTRIBUTES, F.col(SHREDDED_MARK)
    new = stored.where(marked).select(*keep, F.col(typed).alias("_attributes"))
    old = stored.where(marked.isNull()).select(*keep, request_attributes(context).alias("_attributes"))
    return flatten_attributes(new, keep, "_attributes").unionByName(flatten_attributes(old, keep, "_attributes"))
