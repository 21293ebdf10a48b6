"""Recognising and opening message envelopes, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

PLAIN = "json"
VERSIONED = "versioned"
BASE64 = "base64"

BLANKS = " \t\r\n"
BLANK_PATTERN = rf"[{BLANKS}]"
BYTE_ORDER_MARK = "﻿"


def leading_version(message: Column) -> Column:
    """The number written in the first two bytes, NULL unless both are digits."""
    prefix = F.substring(message, 1, 2).cast("string")
    return F.when(prefix.rlike("^[0-9]{2}$"), prefix.cast("int"))


def message_class(message: Column) -> Column:
    """An opening brace means plain JSON, two digits a versioned message, all else base64; in that order."""
    return (
        F.when(F.substring(message, 1, 1) == F.lit(b"{"), F.lit(PLAIN))
        .when(leading_version(message).isNotNull(), F.lit(VERSIONED))
        .otherwise(F.lit(BASE64))
    )


def strict_base64(message: Column) -> Column:
    """Decode only when the whole input is base64 in full groups of four; line breaks and blanks don't count."""
    text = message.cast("string")
    compact = F.regexp_replace(text, BLANK_PATTERN, "")

    def groups_of_four(candidate: Column) -> Column:
        return F.when(F.octet_length(candidate) % 4 == 0, F.try_to_binary(candidate, F.lit("base64")))

    # Looking for a blank is cheap, counting or removing them isn't.
    has_blank = reduce(or_, [F.contains(text, F.lit(blank)) for blank in BLANKS])
    return F.when(has_blank, groups_of_four(compact)).otherwise(groups_of_four(text))


def document_text(document: Column) -> Column:
    """Bytes of a JSON document -> text, without a byte order mark."""
    text = document.cast("string")
    return F.when(F.startswith(text, F.lit(BYTE_ORDER_MARK)), F.substr(text, F.lit(2))).otherwise(text)
