"""Reading JSON event documents field by field, with the producer's type rules.

Spark's typed ``from_json`` turns a wrong-typed field into NULL without a word
and hands out ``12`` and ``"12"`` alike as text.  Messages with such fields must
be refused, so where the JSON type decides, a field is read as a VARIANT; the
others are read as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Off by choice: the document format is plain JSON.
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Fixed value: date, optional time to the minute or second, up to 16 decimals, optional offset.
CREATED_PATTERN = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,16})?)?(Z|[+-](0[0-9]|1[0-3])(:[0-5][0-9])?|[+-]14(:00)?)?)?\z"
)
MINUTE_PRECISION_PATTERN = r"^([0-9-]{10}T[0-9]{2}:[0-9]{2})(Z|[+-].*)?\z"
INTEGER_PATTERN = r"^[+-]?[0-9]+\z"


# Fixed value: text that might have been a JSON number, boolean, object or array.
NOT_ONLY_TEXT_PATTERN = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|[\[{][\s\S]*)\z"
NOT_ONLY_TEXT_BEGINS = "-0123456789tf[{"

# Escapes of half a surrogate pair, behind an even number of backslashes.
_EVEN = r"((?<!\\)(?:\\\\)*)"
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
HIGH_ALONE_PATTERN = rf"{_EVEN}{_HIGH}(?!{_LOW})"
LOW_ALONE_PATTERN = rf"(?<!(?<!\\)(?:\\\\){{0,8}}{_HIGH}){_EVEN}{_LOW}"
NUL_ESCAPE = r"\u0000"
NUL_ESCAPE_PATTERN = rf"{_EVEN}\\u0000"

# Numbers that VARIANT would round: more than 38 digits, or more than a double holds behind an exponent.
MAYBE_ROUNDED_PATTERN = r"[0-9](?:[eE]|[0-9.]{38})"
ROUNDED_PATTERN = r"(?:[0-9]\.?){39}|(?:[0-9]\.?){16}[eE]|[0-9][eE][+-]?0*[1-9][0-9]{2}"
JSON_STRING_PATTERN = r'"(?:[^"\\]|\\.)*+"'


def mark_half_surrogates(text: Column) -> Column:
    """JSON text in which every escaped half of a surrogate pair is an escaped NUL instead.

    Neither can be stored as text, and a NUL is still there after parsing, where
    Spark has put ``?`` for the half.
    """
    marked = F.regexp_replace(F.regexp_replace(text, LOW_ALONE_PATTERN, rf"$1\{NUL_ESCAPE}"), HIGH_ALONE_PATTERN, rf"$1\{NUL_ESCAPE}")
    return F.when(F.contains(text, F.lit("\\u")), marked).otherwise(text)


def unstorable(text: Column) -> Column:
    """Whether a text holds a NUL, which no text column of the store takes."""
    return F.contains(text, F.lit("\0"))


def candidate_documents(text: Column, document_type: str) -> Column:
    """Parse ``[<text>,null]``: the brackets make text after the first document visible.

    Spark stops reading at the end of the first JSON value, so
    ``{"a":1} trailing`` would pass on its own.  ``text`` has to be valid UTF-8; give it as a column,
    as Spark doesn't compile what it hands to its JSON reader and works it out for each mention.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(",null]"))
    return F.from_json(wrapped, f"array<{document_type}>", JSON_OPTIONS)


def only_document(documents: Column) -> Column:
    """The one object among ``candidate_documents``, else NULL."""
    is_single = (F.size(documents) == 2) & F.get(documents, F.lit(1)).isNull()
    return F.when(is_single, F.get(documents, F.lit(0)))


def ignore_key_case(document: Column) -> Column:
    """Document with lower-case keys; of keys that become equal the last wins."""
    return F.transform_keys(document, lambda key, _: F.lower(key))


def rebuild(document: Column) -> Column:
    """Map document in which the last of equal keys is left; parsing alone keeps them all."""
    return F.transform_keys(document, lambda key, _: key)


@dataclass(frozen=True)
class FieldType:
    """How to make a value of a field's text, and how to tell that it has to be refused.

    ``read`` gets the text (NULL for null and for an absent field), the JSON
    type name where it is known, and whether the document is read strictly; it
    yields NULL for what it can't use.  ``refuse`` gets text, type name, whether
    the field is there at all, and the value.
    """

    code: str
    read: Callable[[Column, Column | None, bool], Column]
    refuse: Callable[[Column, Column | None, Column, Column], Column]
    default: object = None
    typed: bool = False


def _unread(text: Column, tag: Column, present: Column, value: Column) -> Column:
    return text.isNotNull() & value.isNull()


def _unread_or_null(text: Column, tag: Column, present: Column, value: Column) -> Column:
    return present & value.isNull()


def maybe_not_text(text: Column) -> Column:
    """Whether a field read as text may have had another JSON type."""
    begins = F.substring(text, 1, 1).isin(*NOT_ONLY_TEXT_BEGINS)
    return F.coalesce(begins & text.rlike(NOT_ONLY_TEXT_PATTERN), F.lit(False))


def _read_integer(text: Column, tag: Column, strict: bool) -> Column:
    """32-bit; lenient documents may give the digits as a string."""
    return F.when(tag == "BIGINT" if strict else text.rlike(INTEGER_PATTERN), text.try_cast("int"))


def decode_choice(text: Column, names: dict[str, int]) -> Column:
    """Enumeration given by name, in any case, or by number (also as text); NULL when it is neither."""
    lookup = F.create_map(*[F.lit(x) for name, number in names.items() for x in (name.lower(), number)])
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    return F.coalesce(lookup[F.lower(trimmed)], F.when(trimmed.rlike(INTEGER_PATTERN), trimmed.try_cast("int")))


def choice(names: dict[str, int], default: int | None = None) -> FieldType:
    """Enumeration field; one with a default takes it when absent and refuses null."""

    def read(text: Column, tag: Column | None, strict: bool) -> Column:
        number = decode_choice(text, names)
        # A VARIANT prints 1.0 as "1", which plain text doesn't.
        return number if tag is None else F.when(tag.isin("BIGINT", "STRING"), number)

    return FieldType("bad_enum", read, _unread if default is None else _unread_or_null, default)


# The type name of texts is only known where one was in doubt.
TEXT = FieldType(
    "bad_string",
    lambda text, tag, strict: F.when((tag.isNull() | (tag == "STRING")) & ~unstorable(text), text),
    lambda text, tag, present, value: ~tag.isin("STRING", "VOID") | unstorable(text),
)
INTEGER = FieldType("bad_int", _read_integer, _unread, typed=True)
INSTANT = FieldType("bad_created", lambda text, tag, strict: parse_created(text), _unread)
FLAG = FieldType(
    "bad_bool",
    lambda text, tag, strict: F.when(tag == "BOOLEAN", text == "true"),
    _unread_or_null,
    default=False,
    typed=True,
)


def parse_created(text: Column) -> Column:
    """ISO 8601 text -> instant. Text without an offset counts as UTC; decimals beyond microseconds are cut."""
    # Spark wants seconds when an offset follows, the format allows "10:00Z".
    with_seconds = F.when(F.substring(text, 17, 1) == ":", text).otherwise(
        F.regexp_replace(text, MINUTE_PRECISION_PATTERN, "$1:00$2")
    )
    return F.when(text.rlike(CREATED_PATTERN), F.try_to_timestamp(with_seconds))


def is_json_object(value: Column) -> Column:
    """Whether a variant is an object, without walking through it."""
    return F.try_variant_get(value, "$", "struct<_: variant>").isNotNull()


def json_or_text(text: Column) -> Column:
    """Text of a field holding JSON, or holding a string with JSON inside, -> VARIANT.

    A string without JSON inside stays a string; unwrapping goes one level deep.
    What can't be kept as it is gives NULL: NUL characters, half surrogate pairs
    and numbers that would be rounded.
    """
    marked = mark_half_surrogates(text)
    bare = F.regexp_replace(text, JSON_STRING_PATTERN, "")
    rounded = text.rlike(MAYBE_ROUNDED_PATTERN) & bare.rlike(ROUNDED_PATTERN)
    escaped = F.contains(text, F.lit("\\u")) & F.contains(marked, F.lit(NUL_ESCAPE)) & marked.rlike(NUL_ESCAPE_PATTERN)
    lost = unstorable(text) | escaped | rounded
    return F.when(~lost, F.coalesce(F.try_parse_json(text), text.cast("variant")))
