"""From JSON text to the typed columns of the event tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from gatewire import vocabulary as v
from gatewire.functions.json_fields import (
    FLAG,
    INSTANT,
    INTEGER,
    TEXT,
    FieldType,
    candidate_documents,
    choice,
    ignore_key_case,
    json_or_text,
    mark_half_surrogates,
    maybe_not_text,
    only_document,
    rebuild,
)
from gatewire.functions.problems import NO_PROBLEMS, add_problems, problem
from gatewire.schemas import FACT_COLUMNS

# Table column -> document property. "IpAdress" is how producers spell it.
AUTHN_TEXTS = {
    "sessionid": "SessionId",
    "externalsessionid": "ExternalSessionId",
    "subscriptionkey": "SubscriptionKey",
    "externaltokenissuer": "ExternalTokenIssuer",
    "supplierid": "SupplierId",
    "ipaddress": "IpAddress",
}
AUTHN_INTEGERS = {"userid": "UserId", "orgnumber": "OrgNumber"}
AUTHZ_TEXTS = {
    "sessionid": "SessionId",
    "subjectorgcode": "SubjectOrgCode",
    "resource": "Resource",
    "instanceid": "InstanceId",
    "operation": "Operation",
    "ipaddress": "IpAdress",
    "subject_party_uuid": "SubjectPartyUuid",
}
AUTHZ_INTEGERS = {
    "subjectuserid": "SubjectUserId",
    "subjectorgnumber": "SubjectOrgNumber",
    "subjectparty": "SubjectParty",
    "resourcepartyid": "ResourcePartyId",
}

# Export order of the document properties of an authentication event.
AUTHN_EXPORT = {
    "sessionId": "sessionid",
    "externalSessionId": "externalsessionid",
    "externalTokenIssuer": "externaltokenissuer",
    "created": "created",
    "userId": "userid",
    "supplierId": "supplierid",
    "orgNumber": "orgnumber",
    "eventType": "eventtypeid",
    "authenticationMethod": "authenticationmethodid",
    "authenticationLevel": "authenticationlevelid",
    "ipAddress": "ipaddress",
    "isAuthenticated": "isauthenticated",
    "subscriptionKey": "subscriptionkey",
}


AUTHN_FIELDS = (
    {column: (name, TEXT) for column, name in AUTHN_TEXTS.items()}
    | {"created": ("Created", INSTANT)}
    | {column: (name, INTEGER) for column, name in AUTHN_INTEGERS.items()}
    | {
        "eventtypeid": ("EventType", choice(v.WIRE_EVENT_TYPE, default=0)),
        "authenticationmethodid": ("AuthenticationMethod", choice(v.WIRE_AUTHENTICATION_METHOD)),
        "authenticationlevelid": ("AuthenticationLevel", choice(v.WIRE_SECURITY_LEVEL)),
        "isauthenticated": ("IsAuthenticated", FLAG),
    }
)
AUTHZ_FIELDS = (
    {column: (name, TEXT) for column, name in AUTHZ_TEXTS.items()}
    | {"created": ("Created", INSTANT)}
    | {column: (name, INTEGER) for column, name in AUTHZ_INTEGERS.items()}
    | {"decision": ("Decision", choice(v.WIRE_DECISION))}
)


def parse_authn(messages: DataFrame, text: str = "body", strict: bool = True) -> DataFrame:
    """Add the typed columns of an authentication event, as sent, and ``problems``.

    Queue messages are read strictly; documents posted directly leniently
    (``strict=False``): key names in any case, numbers also as strings.
    """
    return _read(messages, text, strict, AUTHN_FIELDS)


def parse_authz(messages: DataFrame, text: str = "json", strict: bool = False) -> DataFrame:
    """Add the typed columns of an authorization event, as sent, and ``problems``.

    ``decision`` is the number on the wire, one less than the stored one.  The
    access request may come as JSON or as a string holding JSON.
    """
    events = _read(messages, text, strict, AUTHZ_FIELDS, {"_context": "ContextRequestJson"})
    return events.withColumn("contextrequestjson", json_or_text(F.col("_context"))).drop("_context")


def _read(
    messages: DataFrame,
    text: str,
    strict: bool,
    fields: dict[str, tuple[str, FieldType]],
    verbatim: dict[str, str] | None = None,
) -> DataFrame:
    """Document, field texts, JSON types, values, problems: one projection for each.

    Every step uses columns of the one before, so a document is parsed once and
    no expression is repeated, which also keeps the generated code small.  Only
    a document with a doubtful text (is ``12`` from ``12`` or ``"12"``?) is
    looked at a second time.
    """
    if "problems" not in messages.columns:
        messages = messages.withColumn("problems", F.lit(NO_PROBLEMS))
    verbatim = verbatim or {}
    kept = messages.columns
    names = {column: name for column, (name, _) in fields.items()} | verbatim
    kinds = {column: kind for column, (_, kind) in fields.items()}
    document = F.col("_document")
    # Strict documents have known keys and become a struct, which knows the JSON type of VARIANT
    # fields; lenient ones have to be searched for their keys.
    variants = [c for c, kind in kinds.items() if strict and (kind.typed or kind.default is not None)]
    doubtful = [c for c, kind in kinds.items() if kind is TEXT or (kind is FLAG and not strict)]

    if strict:
        layout = ", ".join(f"{name}: {'variant' if c in variants else 'string'}" for c, name in names.items())
        parsed, field = f"struct<{layout}>", lambda column: document[names[column]]
        opened = F.col("_document")
        present = {c: F.col(f"_variant_{c}").isNotNull() for c in variants}
    else:
        parsed, field = "map<string,string>", lambda column: document[names[column].lower()]
        opened = ignore_key_case(F.col("_document"))
        present = {c: F.map_contains_key(document, names[c].lower()) for c in kinds if kinds[c].default is not None}

    texts = {c: F.try_variant_get(f"_variant_{c}", "$", "string") if c in variants else field(c) for c in names}
    tags = {c: F.schema_of_variant(f"_variant_{c}") for c in variants} | {
        c: F.schema_of_variant(F.col("_exact")[names[c] if strict else names[c].lower()]) for c in doubtful
    }

    def value(column: str, kind: FieldType) -> Column:
        found = kind.read(F.col(f"_text_{column}"), tags.get(column), strict)
        if kind.default is None:
            return found
        absent = F.col("_is_object") & ~F.col(f"_present_{column}")
        return F.when(absent, F.lit(kind.default)).otherwise(found)

    def refused(column: str, kind: FieldType) -> Column:
        there = F.col(f"_present_{column}") if kind.default is not None else F.lit(None)
        return kind.refuse(F.col(f"_text_{column}"), tags.get(column), there, F.col(column))

    in_doubt = reduce(or_, [maybe_not_text(F.col(f"_text_{c}")) for c in doubtful])
    readable = F.col("problems") == NO_PROBLEMS
    found = [problem("not_object", {text: readable & ~F.col("_is_object")})]
    for code in dict.fromkeys(kind.code for kind in kinds.values()):
        found.append(problem(code, {names[c]: refused(c, kind) for c, kind in kinds.items() if kind.code == code}))
    parsed_events = (
        messages.withColumn("_source", mark_half_surrogates(F.try_validate_utf8(F.when(readable, F.col(text)))))
        .withColumn("_documents", candidate_documents(F.col("_source"), parsed))
        .withColumn("_document", only_document(F.col("_documents")))
        .withColumn("_document", opened)
        .withColumns({f"_variant_{c}": field(c) for c in variants} | {"_is_object": document.isNotNull()})
        .withColumns({f"_text_{c}": x for c, x in texts.items()} | {f"_present_{c}": x for c, x in present.items()})
        .withColumn("_doubted", F.when(in_doubt, F.col("_source")))
        .withColumn("_exact", candidate_documents(F.col("_doubted"), "map<string,variant>"))
        # naming the column once more keeps Catalyst from moving its condition into the JSON reader's input
        .withColumn("_exact", F.when(F.col("_doubted").isNotNull(), only_document(F.col("_exact"))))
        .withColumn("_exact", rebuild(F.col("_exact")) if strict else ignore_key_case(F.col("_exact")))
        .withColumns({c: value(c, kind) for c, kind in kinds.items()})
        .withColumn("problems", add_problems(F.col("problems"), *found))
    )
    # Catalyst would put a later filter on these columns below all the steps above and so repeat
    # the parsing for every column it mentions. It doesn't look through a generator.
    event = F.struct(*kinds, *[F.col(f"_text_{c}").alias(c) for c in verbatim], "problems")
    return parsed_events.select(*[c for c in kept if c != "problems"], F.inline(F.array(event)))


def empty_to_null(events: DataFrame, columns: list[str]) -> DataFrame:
    """The empty text is stored as NULL; blanks stay."""
    return events.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def stored_decision(wire: Column) -> Column:
    """Stored decisions start at 1, those on the wire at 0."""
    return F.try_add(wire, F.lit(1))


def conform(events: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed events -> table columns in table order, with what the tables store.

    Columns that aren't in the table go, except those named in ``keep``.
    """
    layout = FACT_COLUMNS[kind]
    if kind == "authz":
        events = events.withColumn("decision", stored_decision(F.col("decision")))
    events = empty_to_null(events, list(AUTHN_TEXTS if kind == "authn" else AUTHZ_TEXTS))
    return events.select(*keep, *[F.col(c).cast(t).alias(c) for c, t in layout.items()])


def authn_to_json(events: DataFrame, column: str = "json") -> DataFrame:
    """Add the event as a JSON document: camel-case names, numbers for enumerations, nulls written."""
    decimals = F.regexp_replace(F.date_format("created", ".SSSSSS"), r"\.?0+$", "")
    instant = F.concat(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), decimals, F.lit("+00:00"))
    fields = [(instant if c == "created" else F.col(c)).alias(p) for p, c in AUTHN_EXPORT.items()]
    return events.withColumn(column, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
