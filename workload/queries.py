"""One query per operator, each with the result expected of it in plain SQL.

The SQL states results from the base tables directly: it knows from an event's
number which message was made of it and what has to become of that message, and
never decodes or parses anything.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewire import vocabulary as v
from gatewire.functions import envelope as env
from gatewire.functions import months
from gatewire.functions.brotli import brotli_decompress
from gatewire.functions.json_fields import decode_choice, json_or_text, parse_created
from gatewire.functions.problems import errors_map
from gatewire.operators import lookups, partitions, readouts
from gatewire.operators.envelope import classify, decode, drop_short, unwrap
from gatewire.operators.parse import (
    AUTHN_TEXTS,
    AUTHZ_TEXTS,
    authn_to_json,
    conform,
    empty_to_null,
    parse_authn,
    parse_authz,
    stored_decision,
)
from gatewire.operators.shred import flatten_stored
from gatewire.plans.compact import compact
from gatewire.plans.ingest import accepted, check_authn, check_authz, check_authz_documents
from gatewire.plans.maintenance import maintain, run_maintenance
from gatewire.plans.reprocess import reprocess
from gatewire.schemas import AUTHN_COLUMNS, AUTHZ_COLUMNS
from gatewire.session import configure, scratch_dir
from gatewire.sources import batches, folders, tables, zones
from gatewire.sources.catalog import load_catalog, save_catalog
from gatewire.sources.dimensions import current_dimensions, load_dimensions, save_dimensions, seed_dimensions
from gatewire.sources.generations import Registry, append_generation, read_generation
from gatewire.sources.messages import read_messages
from gatewire.sources.queue import read_queue, send
from gatewire.streaming.ingest import start_ingest
from workload import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS_DAY = dt.date(2024, 1, 15)
ORDERS_DAY = dt.date(2001, 8, 15)


def query(name: str, expected: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if expected:
            ORACLES[name] = expected
        return build

    return register


# --- pieces of expected results -----------------------------------------------

AUTHN = feeds.AUTHN_EVENTS.format(**feeds.CHECKER)
AUTHZ = feeds.AUTHZ_EVENTS.format(**feeds.CHECKER)
AUTHN_MESSAGES = feeds.authn_messages_sql(feeds.CHECKER)
AUTHZ_DOCUMENTS = feeds.authz_documents_sql(feeds.CHECKER)

AUTHN_READABLE = "k NOT IN (87, 90, 91)"
AUTHZ_READABLE = "k NOT IN (90, 91)"


def _values(rows: list[tuple], columns: str) -> str:
    def literal(x) -> str:
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, row)) + ')' for row in rows)}) AS t({columns})"


METHOD_ROWS = v.AUTHENTICATION_METHOD_ROWS + v.AUTHENTICATION_METHOD_LATER_ROWS
DIMENSION_SQL = {
    "authenticationeventtype": _values(v.EVENT_TYPE_ROWS, "id, name, description"),
    "authenticationmethod": _values(METHOD_ROWS, "id, name, description"),
    "authenticationlevel": _values(v.SECURITY_LEVEL_ROWS, "id, name, description"),
    "decision": _values(v.DECISION_ROWS, "id, name, description"),
}


def _codes(conditions: dict[str, str]) -> str:
    """SQL for the comma-separated, sorted codes whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {conditions[c]} THEN '{c}' END" for c in sorted(conditions)) + ")"


AUTHN_PARSE_ERRORS = {
    "bad_bool": "k = 98",
    "bad_created": "k = 85",
    "bad_enum": "k = 96",
    "bad_int": "k IN (93, 94, 95)",
    "bad_string": "k = 86",
}
AUTHN_ERRORS = AUTHN_PARSE_ERRORS | {
    "created_missing": "k = 92",
    "fk_eventtype": "(k = 89 OR (eventtypeid = 0 AND k <> 96))",
    "fk_level": "authenticationlevelid = 5",
    "fk_method": "authenticationmethodid = 23",
}
AUTHZ_PARSE_ERRORS = {"bad_enum": "k = 99", "bad_int": "k = 97"}
AUTHZ_ERRORS = AUTHZ_PARSE_ERRORS | {
    "context_not_object": "k IN (89, 94)",
    "created_missing": "k = 92",
    "decision_missing": "k = 95",
    "decision_range": "(k = 88 OR (decision = 4 AND k NOT IN (87, 95, 99)))",
    "operation_missing": "k IN (7, 93)",
    "uuid_too_long": "k = 98",
}


def _outcome(readable: str, errors: dict[str, str]) -> str:
    return f"CASE WHEN NOT ({readable}) THEN 'not_object' ELSE {_codes(errors)} END"


AUTHN_OUTCOME = _outcome(AUTHN_READABLE, AUTHN_ERRORS)
AUTHZ_OUTCOME = _outcome(AUTHZ_READABLE, AUTHZ_ERRORS)
# 'null' in an envelope is four base64 characters, also behind a blank.
RAW_OUTCOME = f"""
    CASE
      WHEN event_id % 8 = 4 THEN 'unsupported_version'
      WHEN event_id % 8 = 6 AND k <> 90 THEN 'bad_base64'
      WHEN event_id % 8 = 7 THEN 'bad_brotli'
      ELSE {AUTHZ_OUTCOME} END"""

# What the strict reader gets out of an authentication message.
AUTHN_PARSED = {
    "sessionid": "CASE WHEN k <> 86 THEN sessionid END",
    "externalsessionid": "externalsessionid",
    "subscriptionkey": "subscriptionkey",
    "externaltokenissuer": "externaltokenissuer",
    "created": "CASE WHEN k NOT IN (85, 92) THEN created END",
    "userid": "CASE WHEN k NOT IN (93, 94, 95, 97) THEN userid END",
    "supplierid": "supplierid",
    "orgnumber": "orgnumber",
    "eventtypeid": "CASE WHEN k = 89 THEN 0 WHEN k <> 96 THEN eventtypeid END",
    "authenticationmethodid": "authenticationmethodid",
    "authenticationlevelid": "authenticationlevelid",
    "ipaddress": "ipaddress",
    "isauthenticated": "CASE WHEN k = 88 THEN FALSE WHEN k <> 98 THEN isauthenticated END",
}
AUTHZ_PARSED = {
    "sessionid": "sessionid",
    "created": "CASE WHEN k <> 92 THEN created END",
    "subjectuserid": "CASE WHEN k <> 97 THEN subjectuserid END",
    "subjectorgcode": "subjectorgcode",
    "subjectorgnumber": "subjectorgnumber",
    "subjectparty": "subjectparty",
    "resourcepartyid": "resourcepartyid",
    "resource": "resource",
    "instanceid": "instanceid",
    "operation": "CASE WHEN k <> 93 THEN operation END",
    "ipaddress": "ipaddress",
    "decision": "CASE WHEN k = 87 THEN 1 WHEN k = 88 THEN 2147483647 WHEN k NOT IN (95, 99) THEN decision END",
    "subject_party_uuid": "CASE WHEN k = 98 THEN repeat('u', 256) ELSE subject_party_uuid END",
}
CONTEXT_READS = {
    "ctx_xpath_is_null": "TRUE",
    "ctx_user": "CAST(user_id AS STRING)",
    "ctx_action": "event_type",
}


def _select(columns: dict[str, str], readable: str = "TRUE") -> str:
    return ", ".join(f"CASE WHEN {readable} THEN {sql} END AS {name}" for name, sql in columns.items())


def _stored(columns: dict[str, str], kind: str) -> dict[str, str]:
    """Parsed values as the tables keep them."""
    texts = AUTHN_TEXTS if kind == "authn" else AUTHZ_TEXTS
    stored = {c: f"NULLIF({sql}, '')" if c in texts else sql for c, sql in columns.items()}
    if kind == "authz":
        stored["decision"] = f"({columns['decision']}) + 1"
    return stored


MONTH = "CAST(date_trunc('month', {}) AS DATE)"


def _plain(column: str) -> Column:
    """Instant as a UTC wall-clock time, which both engines print alike."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def _plain_events(events: DataFrame, columns, *more) -> DataFrame:
    names = [c for c in columns if c != "contextrequestjson"]
    return events.select(*more, *[_plain(c) if c == "created" else F.col(c) for c in names])


def _context_reads(context: str = "contextrequestjson") -> list[Column]:
    value = "$.Attributes[{}].Attributes[0].AttributeValues[0].Value"
    xpath = F.try_variant_get(context, "$.XPathVersion", "variant")
    return [
        F.when(xpath.isNotNull(), F.is_variant_null(xpath)).alias("ctx_xpath_is_null"),
        F.try_variant_get(context, value.format(0), "string").alias("ctx_user"),
        F.try_variant_get(context, value.format(1), "string").alias("ctx_action"),
    ]


def _error_codes(errors: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(errors)), ",").alias("codes")


def _catalog(spark: SparkSession, day: dt.date) -> DataFrame:
    return partitions.plan_partitions(partitions.on_day(spark, day))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = feeds.table(spark, sf_dir, "orders")
    return orders.withColumn("created", F.col("o_orderdate").cast("timestamp"))


def _order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition list with every month that has orders."""
    days = _orders(spark, sf_dir).select(months.month_start(F.col("created")).alias("as_of")).distinct()
    return partitions.describe_months(days, F.col("as_of"))


ORDER_MONTHS = f"""
    SELECT s.schema_name, strftime(m, 'eventlogv1_y%Ym%m') AS name, m AS start_date,
           CAST(m + INTERVAL 1 MONTH AS DATE) AS end_date
    FROM (SELECT DISTINCT {MONTH.format('o_orderdate')} AS m FROM orders) d
    CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)
"""


def _describe_sql(month: str) -> str:
    return (
        f"s.schema_name, strftime({month}, 'eventlogv1_y%Ym%m') AS name, {month} AS start_date,"
        f" CAST({month} + INTERVAL 1 MONTH AS DATE) AS end_date"
    )


# --- sources and sinks --------------------------------------------------------


@query("a1_authn_source", f"""SELECT replace(body, ',"', ',' || chr(10) || '"') AS body FROM ({AUTHN_MESSAGES})""")
def a1_authn_source(spark, sf_dir):
    """Messages with line breaks in a text file."""
    path = scratch_dir(spark, "a1") + "/queue"
    lines = F.replace(F.col("body"), F.lit(',"'), F.lit(',\n"'))
    messages = feeds.stored(spark, sf_dir, "authn_messages").select(lines.alias("body"))
    messages.write.option("lineSep", "\x1e").text(path)
    return read_messages(spark, path, "authn", fmt="text", lineSep="\x1e").select("body")


@query(
    "a2_authz_source",
    f"SELECT msg_id, CAST(strlen(json) AS INTEGER) AS n_bytes, md5(json) AS body_md5 FROM ({AUTHZ_DOCUMENTS})",
)
def a2_authz_source(spark, sf_dir):
    path = scratch_dir(spark, "a2") + "/queue"
    documents = feeds.stored(spark, sf_dir, "authz_documents")
    documents.select("msg_id", F.col("json").cast("binary").alias("body")).write.parquet(path)
    messages = read_messages(spark, path, "authz")
    return messages.select("msg_id", F.length("body").alias("n_bytes"), F.md5("body").alias("body_md5"))


AUTHN_LENIENT = AUTHN_PARSED | {"userid": "CASE WHEN k NOT IN (94, 95) THEN userid END"}


@query(
    "a3_authn_json_batch",
    f"""SELECT event_id AS msg_id, {_select(_stored(AUTHN_LENIENT, 'authn'), AUTHN_READABLE)},
        {_outcome(AUTHN_READABLE, AUTHN_ERRORS | {'bad_int': 'k IN (94, 95)'})} AS codes FROM ({AUTHN})""",
)
def a3_authn_json_batch(spark, sf_dir):
    posted = read_messages(spark, feeds.stored_path(spark, sf_dir, "authn_messages"), "authn")
    checked = check_authn(posted, current_dimensions(spark), _catalog(spark, EVENTS_DAY), strict=False)
    return _plain_events(checked, AUTHN_COLUMNS, "msg_id", _error_codes(F.col("errors")))


AUTHZ_STORED_CHECKED = _stored(AUTHZ_PARSED, "authz") | {
    "decision": "CASE WHEN k = 87 THEN 2 WHEN k NOT IN (88, 95, 99) THEN decision + 1 END"
}


@query(
    "a4_authz_json_batch",
    f"""SELECT event_id AS msg_id, {_select(AUTHZ_STORED_CHECKED, AUTHZ_READABLE)},
        {AUTHZ_OUTCOME} AS codes FROM ({AUTHZ})""",
)
def a4_authz_json_batch(spark, sf_dir):
    posted = feeds.stored(spark, sf_dir, "authz_documents").withColumnRenamed("json", "body")
    checked = check_authz_documents(posted, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
    return _plain_events(checked, AUTHZ_COLUMNS, "msg_id", _error_codes(F.col("errors")))


AUTHN_TYPED = {c: c for c in AUTHN_COLUMNS}
AUTHZ_TYPED = {c: c for c in AUTHZ_COLUMNS if c != "contextrequestjson"}


@query(
    "a5_authn_append",
    f"""SELECT {_select(_stored(AUTHN_TYPED, 'authn'))}, {MONTH.format('created')} AS created_month
        FROM ({AUTHN}) CROSS JOIN (VALUES (1), (2)) AS twice(n)""",
)
def a5_authn_append(spark, sf_dir):
    path = scratch_dir(spark, "a5") + "/events"
    events = conform(feeds.authn_events(spark, sf_dir), "authn")
    for _ in range(2):  # appending the same events again stores them again
        tables.append_events(events, path)
    return _plain_events(tables.read_events(spark, path, "authn"), AUTHN_COLUMNS, "created_month")


@query(
    "a6_authz_append",
    f"""SELECT {_select(_stored(AUTHZ_TYPED, 'authz') | CONTEXT_READS)}, {MONTH.format('created')} AS created_month
        FROM ({AUTHZ})""",
)
def a6_authz_append(spark, sf_dir):
    path = scratch_dir(spark, "a6") + "/events"
    tables.append_events(conform(feeds.authz_events(spark, sf_dir), "authz"), path)
    stored = tables.read_events(spark, path, "authz")
    return _plain_events(stored, AUTHZ_COLUMNS, "created_month", *_context_reads())


REFERENCED = {
    "authenticationeventtype": ("eventtypeid", AUTHN),
    "authenticationlevel": ("authenticationlevelid", AUTHN),
    "authenticationmethod": ("authenticationmethodid", AUTHN),
    "decision": ("decision + 1", AUTHZ),
}


@query(
    "a7_dim_seed",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, t.id, t.name, t.description, count(e.id) AS n_events
            FROM {DIMENSION_SQL[name] if name != 'authenticationmethod' else
                  _values(v.AUTHENTICATION_METHOD_ROWS, 'id, name, description')}
            LEFT JOIN (SELECT {column} AS id FROM ({source})) e ON e.id = t.id GROUP BY ALL"""
        for name, (column, source) in REFERENCED.items()
    ),
)
def a7_dim_seed(spark, sf_dir):
    """The seeded lookup tables, each row with the number of events that refer to it."""
    root = scratch_dir(spark, "a7") + "/dimensions"
    save_dimensions(seed_dimensions(spark), root)
    dimensions = load_dimensions(spark, root)
    authn = feeds.authn_events(spark, sf_dir)
    authz = feeds.authz_events(spark, sf_dir).withColumn("decision", stored_decision(F.col("decision")))

    def references(events: DataFrame, kind: str) -> DataFrame:
        """Dimension and id of every reference, all from one pass over the events."""
        pairs = [
            F.struct(F.lit(ref.dimension).alias("dimension"), F.col(ref.column).alias("id"))
            for ref in lookups.REFERENCES[kind]
        ]
        return events.select(F.inline(F.array(*pairs)))

    used = references(authn, "authn").unionByName(references(authz, "authz"))
    counts = used.groupBy("dimension", "id").agg(F.count("*").alias("n"))
    rows = None
    for name, dimension in dimensions.items():
        part = dimension.select(F.lit(name).alias("dimension"), "id", "name", "description")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(counts, ["dimension", "id"], "left").select(
        "dimension", "id", "name", "description", F.coalesce("n", F.lit(0)).alias("n_events")
    )


@query(
    "a8_dim_insert_if_absent",
    f"""SELECT * FROM {DIMENSION_SQL['authenticationmethod']}
        UNION ALL
        SELECT k % 30 AS id, min('candidate ' || CAST(event_id AS STRING)) AS name, 'from events' AS description
        FROM ({AUTHN}) WHERE k % 30 NOT IN (SELECT id FROM {DIMENSION_SQL['authenticationmethod']}) GROUP BY 1""",
)
def a8_dim_insert_if_absent(spark, sf_dir):
    candidates = feeds.authn_events(spark, sf_dir).select(
        (F.col("k") % 30).alias("id"),
        F.concat(F.lit("candidate "), F.col("event_id").cast("string")).alias("name"),
        F.lit("from events").alias("description"),
    )
    return lookups.insert_if_absent(current_dimensions(spark)["authenticationmethod"], candidates)


@query(
    "a9_quarantine",
    f"""SELECT * FROM (SELECT event_id AS msg_id, {RAW_OUTCOME} AS codes FROM ({AUTHZ}) WHERE event_id % 8 <> 5)
        WHERE codes <> ''""",
)
def a9_quarantine(spark, sf_dir):
    root = scratch_dir(spark, "a9") + "/authz"
    raw = feeds.stored(spark, sf_dir, "raw_messages")
    tables.write_checked(check_authz(raw, current_dimensions(spark), _catalog(spark, EVENTS_DAY)), root, "authz")
    return tables.read_quarantine(spark, root).select("msg_id", _error_codes(F.col("errors")))


@query(
    "a9_reprocess",
    f"""SELECT event_id AS msg_id, {RAW_OUTCOME} AS codes FROM ({AUTHZ}) WHERE event_id % 8 <> 5 AND {RAW_OUTCOME} <> ''
        UNION ALL
        SELECT count(*), 'accepted' FROM ({AUTHZ}) WHERE event_id % 8 <> 5 AND {RAW_OUTCOME} = ''""",
)
def a9_reprocess(spark, sf_dir):
    """What is left of the quarantine, and the number of events, once partitions came that were missing."""
    root = scratch_dir(spark, "a9r") + "/authz"
    raw, dimensions = feeds.stored(spark, sf_dir, "raw_messages"), current_dimensions(spark)
    too_early = _catalog(spark, dt.date(1990, 1, 1))
    tables.write_checked(check_authz(raw, dimensions, too_early), root, "authz", "queue")
    for _ in range(2):
        reprocess(spark, root, "authz", dimensions, _catalog(spark, EVENTS_DAY))
    left = tables.read_quarantine(spark, root).select("msg_id", _error_codes(F.col("errors")))
    taken = tables.read_accepted(spark, root, "authz").agg(F.count("*").alias("msg_id"), F.lit("accepted").alias("codes"))
    return left.unionByName(taken)


@query(
    "a9_attempts",
    f"""SELECT event_id AS msg_id, {RAW_OUTCOME} AS codes,
               CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS attempts, event_id % 2 = 0 AS resting
        FROM ({AUTHZ}) WHERE event_id % 8 <> 5 AND {RAW_OUTCOME} <> ''
        UNION ALL
        SELECT count(*), 'accepted', NULL, NULL FROM ({AUTHZ}) WHERE event_id % 8 <> 5 AND {RAW_OUTCOME} = ''""",
)
def a9_attempts(spark, sf_dir):
    """Two batches, one named like a further try of the other: refused messages with their tries, of which they get three."""
    root = scratch_dir(spark, "a9a") + "/authz"
    raw, dimensions = feeds.stored(spark, sf_dir, "raw_messages"), current_dimensions(spark)
    too_early, open_months = _catalog(spark, dt.date(1990, 1, 1)), _catalog(spark, EVENTS_DAY)
    for rest, batch in enumerate(("queue", "queue~1")):
        part = raw.where(F.col("msg_id") % 2 == rest)
        tables.write_checked(check_authz(part, dimensions, too_early), root, "authz", batch)
        reprocess(spark, root, "authz", dimensions, open_months, tries=3)
    kinds = {False: tables.read_quarantine(spark, root), True: tables.read_resting(spark, root)}
    columns = ["msg_id", _error_codes(F.col("errors")), "attempts"]
    left = [rows.select(*columns, F.lit(resting).alias("resting")) for resting, rows in kinds.items()]
    accepted_count = [F.count("*").alias("msg_id"), F.lit("accepted").alias("codes")]
    taken = tables.read_accepted(spark, root, "authz").agg(*accepted_count)
    return left[0].unionByName(left[1]).unionByName(taken, allowMissingColumns=True)


# --- envelopes ----------------------------------------------------------------


@query("b1_drop_short", "SELECT event_id AS msg_id FROM events WHERE event_id % 8 <> 5")
def b1_drop_short(spark, sf_dir):
    return drop_short(feeds.stored(spark, sf_dir, "raw_messages")).select("msg_id")


@query(
    "b2_classify",
    f"""SELECT event_id AS msg_id,
          CASE WHEN event_id % 8 IN (2, 4, 7) THEN 'versioned'
               WHEN event_id % 8 = 5 OR (event_id % 8 = 0 AND k <> 90) THEN 'json'
               ELSE 'base64' END AS message_class
        FROM ({AUTHZ})""",
)
def b2_classify(spark, sf_dir):
    return classify(feeds.stored(spark, sf_dir, "raw_messages")).select("msg_id", "message_class")


@query(
    "b3_version",
    """SELECT event_id AS msg_id, CASE WHEN event_id % 8 IN (2, 7) THEN 1 WHEN event_id % 8 = 4 THEN 99 END AS version
       FROM events""",
)
def b3_version(spark, sf_dir):
    raw = feeds.stored(spark, sf_dir, "raw_messages")
    return raw.select("msg_id", env.leading_version(F.col("body")).alias("version"))


@query(
    "b4_base64",
    """SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN CAST(strlen(text) AS INTEGER) END AS n_bytes,
              CASE WHEN doc_id % 10 NOT IN (3, 4) THEN md5(text) END AS content_md5
       FROM documents""",
)
def b4_base64(spark, sf_dir):
    """Whole texts as base64; some with a foreign character, some with a group cut, some with line breaks."""
    messages = feeds.stored(spark, sf_dir, "base64_texts")
    content = messages.select("doc_id", env.strict_base64(F.col("body")).alias("content"))
    return content.select("doc_id", F.length("content").alias("n_bytes"), F.md5("content").alias("content_md5"))


@query(
    "b5_base64_versioned",
    "SELECT event_id AS msg_id, 1 AS version FROM events WHERE event_id % 8 = 3",
)
def b5_base64_versioned(spark, sf_dir):
    opened = unwrap(feeds.stored(spark, sf_dir, "raw_messages"))
    inner = (F.col("message_class") == env.BASE64) & F.col("version").isNotNull()
    return opened.where(inner).select("msg_id", "version")


# 'null' without an envelope is read as base64 and becomes three bytes of no meaning.
@query(
    "b6_legacy",
    f"""SELECT msg_id, CASE WHEN k = 90 AND msg_id % 8 <> 1 THEN md5(from_base64('null')) ELSE md5(json) END AS json_md5
        FROM ({AUTHZ_DOCUMENTS}) WHERE msg_id % 8 IN (0, 1) OR (msg_id % 8 = 6 AND k = 90)""",
)
def b6_legacy(spark, sf_dir):
    opened = unwrap(drop_short(feeds.stored(spark, sf_dir, "raw_messages")))
    legacy = opened.where(F.col("version").isNull() & F.col("content").isNotNull())
    return legacy.select("msg_id", F.md5("content").alias("json_md5"))


@query(
    "b7_version_dispatch",
    f"""SELECT event_id AS msg_id,
          CASE event_id % 8 WHEN 4 THEN 'unsupported_version' WHEN 7 THEN 'bad_brotli'
               WHEN 6 THEN CASE WHEN k = 90 THEN '' ELSE 'bad_base64' END ELSE '' END AS codes
        FROM ({AUTHZ}) WHERE event_id % 8 <> 5""",
)
def b7_version_dispatch(spark, sf_dir):
    decoded = decode(feeds.stored(spark, sf_dir, "raw_messages"))
    return decoded.select("msg_id", _error_codes(errors_map(F.col("problems"))))


@query(
    "b8_brotli",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN CAST(strlen(text) AS INTEGER) END AS n_bytes,
              CASE WHEN doc_id % 10 <> 7 THEN md5(text) END AS content_md5
       FROM documents""",
)
def b8_brotli(spark, sf_dir):
    """Whole texts, compressed and decompressed; some streams lack their end."""
    packed = feeds.stored(spark, sf_dir, "brotli_texts")
    content = packed.select("doc_id", brotli_decompress(F.col("payload")).alias("content"))
    return content.select("doc_id", F.length("content").alias("n_bytes"), F.md5("content").alias("content_md5"))


# --- parsing and conforming ---------------------------------------------------


@query(
    "d1_parse_authn",
    f"""SELECT event_id AS msg_id, {_select(AUTHN_PARSED, AUTHN_READABLE)},
        {_outcome(AUTHN_READABLE, AUTHN_PARSE_ERRORS)} AS codes FROM ({AUTHN})""",
)
def d1_parse_authn(spark, sf_dir):
    parsed = parse_authn(feeds.stored(spark, sf_dir, "authn_messages"))
    return _plain_events(parsed, AUTHN_COLUMNS, "msg_id", _error_codes(errors_map(F.col("problems"))))


@query(
    "d2_parse_authz",
    f"""SELECT event_id AS msg_id, {_select(AUTHZ_PARSED, AUTHZ_READABLE)},
        {_outcome(AUTHZ_READABLE, AUTHZ_PARSE_ERRORS)} AS codes FROM ({AUTHZ})""",
)
def d2_parse_authz(spark, sf_dir):
    parsed = parse_authz(feeds.stored(spark, sf_dir, "authz_documents"))
    return _plain_events(parsed, AUTHZ_COLUMNS, "msg_id", _error_codes(errors_map(F.col("problems"))))


WIRE_NAMES = {
    "event_type": v.WIRE_EVENT_TYPE,
    "method": v.WIRE_AUTHENTICATION_METHOD,
    "level": v.WIRE_SECURITY_LEVEL,
    "decision": v.WIRE_DECISION,
}


def _spellings(column: str, names: dict[str, int]) -> str:
    """Name of the (k mod n)-th member, its case changing from event to event; sometimes digits or an unknown name."""
    members = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    name = f"CASE k % {len(names)} {members} END"
    return f"""CASE event_id % 5 WHEN 0 THEN {name} WHEN 1 THEN lower({name}) WHEN 2 THEN upper({name})
               WHEN 3 THEN CAST(k AS STRING) ELSE 'x' || {name} END AS {column}"""


def _members(column: str, names: dict[str, int]) -> str:
    members = " ".join(f"WHEN {i} THEN {number}" for i, number in enumerate(names.values()))
    return f"""CASE WHEN event_id % 5 < 3 THEN CASE k % {len(names)} {members} END
               WHEN event_id % 5 = 3 THEN k END AS {column}"""


@query(
    "d3_enum_decode",
    f"SELECT event_id, {', '.join(_members(c, n) for c, n in WIRE_NAMES.items())} FROM ({AUTHN})",
)
def d3_enum_decode(spark, sf_dir):
    spelled = feeds._run(
        spark,
        sf_dir,
        f"""SELECT event_id, {', '.join(_spellings(c, n) for c, n in WIRE_NAMES.items())}
            FROM ({feeds.AUTHN_EVENTS.format(**feeds.SPARK)})""",
    )
    return spelled.select("event_id", *[decode_choice(F.col(c), n).alias(c) for c, n in WIRE_NAMES.items()])


@query(
    "d4_context_normalise",
    f"""SELECT event_id AS msg_id,
          CASE WHEN k IN (90, 91) THEN NULL WHEN k = 94 THEN 'ARRAY' WHEN k = 89 THEN 'STRING'
               ELSE 'OBJECT' END AS shape,
          {_select(CONTEXT_READS, 'k NOT IN (89, 90, 91, 94)')}
        FROM ({AUTHZ})""",
)
def d4_context_normalise(spark, sf_dir):
    parsed = parse_authz(feeds.stored(spark, sf_dir, "authz_documents"))
    shape = F.regexp_extract(F.schema_of_variant("contextrequestjson"), "^[A-Z]+", 0).alias("shape")
    return parsed.select("msg_id", shape, *_context_reads())


@query(
    "d5_variant",
    f"""SELECT event_id, 'x' || CAST(event_id AS STRING) AS outer_key, user_id AS inner_key, 2 AS n_numbers,
          TRUE AS no_value
        FROM ({AUTHZ})""",
)
def d5_variant(spark, sf_dir):
    """Stored documents keep the last of repeated keys, at any depth."""
    text = F.concat(
        F.lit('{"b":{"k":0,"k":'),
        F.col("user_id").cast("string"),
        F.lit('},"a":"first","n":[1,2],"z":null,"a":"x'),
        F.col("event_id").cast("string"),
        F.lit('"}'),
    )
    documents = feeds.table(spark, sf_dir, "events").select("event_id", json_or_text(text).alias("doc"))
    return documents.select(
        "event_id",
        F.try_variant_get("doc", "$.a", "string").alias("outer_key"),
        F.try_variant_get("doc", "$.b.k", "bigint").alias("inner_key"),
        F.size(F.try_variant_get("doc", "$.n", "array<int>")).alias("n_numbers"),
        F.is_variant_null(F.try_variant_get("doc", "$.z", "variant")).alias("no_value"),
    )


@query(
    "d6_created_utc",
    f"""SELECT event_id,
          CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts
            WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS created
        FROM events""",
)
def d6_created_utc(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events")
    micro = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    case = F.col("event_id") % 6
    text = (
        F.when(case == 0, F.concat(F.date_format("ts", micro), F.lit("Z")))
        .when(case == 1, F.concat(F.date_format(F.expr("ts - INTERVAL '5:30' HOUR TO MINUTE"), micro), F.lit("-05:30")))
        .when(case == 2, F.concat(F.date_format("ts", micro), F.lit("9")))
        .when(case == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("Z")))
        .when(case == 4, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    )
    return events.select("event_id", parse_created(text).cast("timestamp_ntz").alias("created"))


EMPTY_TO_NULL_TEXTS = list(dict.fromkeys([*AUTHN_TEXTS, *AUTHZ_TEXTS]))


def _emptied(kind: str, texts, source: str) -> str:
    columns = ", ".join(
        (f"NULLIF({c}, '')" if c in texts else "CAST(NULL AS STRING)") + f" AS {c}" for c in EMPTY_TO_NULL_TEXTS
    )
    return f"SELECT event_id, '{kind}' AS kind, {columns} FROM ({source})"


@query(
    "d7_empty_to_null",
    f"{_emptied('authn', AUTHN_TEXTS, AUTHN)} UNION ALL {_emptied('authz', AUTHZ_TEXTS, AUTHZ)}",
)
def d7_empty_to_null(spark, sf_dir):
    def cleaned(events: DataFrame, kind: str, texts) -> DataFrame:
        return empty_to_null(events, list(texts)).select("event_id", F.lit(kind).alias("kind"), *texts)

    authn = cleaned(feeds.authn_events(spark, sf_dir), "authn", AUTHN_TEXTS)
    authz = cleaned(feeds.authz_events(spark, sf_dir), "authz", AUTHZ_TEXTS)
    return authn.unionByName(authz, allowMissingColumns=True)


@query(
    "d8_defaults",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 END AS eventtypeid,
          CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS isauthenticated,
          CASE WHEN event_id % 3 = 2 THEN 'bad_bool,bad_enum' ELSE '' END AS codes
       FROM events""",
)
def d8_defaults(spark, sf_dir):
    """Fields present, absent, and null; the last may not be."""
    body = (
        F.when(F.col("event_id") % 3 == 0, F.lit('{"EventType":4,"IsAuthenticated":true}'))
        .when(F.col("event_id") % 3 == 1, F.lit("{}"))
        .otherwise(F.lit('{"EventType":null,"IsAuthenticated":null}'))
    )
    parsed = parse_authn(feeds.table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return parsed.select("event_id", "eventtypeid", "isauthenticated", _error_codes(errors_map(F.col("problems"))))


@query("d9_decision_shift", f"SELECT event_id, decision + 1 AS decision FROM ({AUTHZ})")
def d9_decision_shift(spark, sf_dir):
    return feeds.authz_events(spark, sf_dir).select("event_id", stored_decision(F.col("decision")).alias("decision"))


@query("d10_conform_authn", f"SELECT {_select(_stored(AUTHN_TYPED, 'authn'))} FROM ({AUTHN})")
def d10_conform_authn(spark, sf_dir):
    return _plain_events(conform(feeds.authn_events(spark, sf_dir), "authn"), AUTHN_COLUMNS)


@query("d10_conform_authz", f"SELECT {_select(_stored(AUTHZ_TYPED, 'authz') | CONTEXT_READS)} FROM ({AUTHZ})")
def d10_conform_authz(spark, sf_dir):
    return _plain_events(conform(feeds.authz_events(spark, sf_dir), "authz"), AUTHZ_COLUMNS, *_context_reads())


def _json_member(name: str, column: str) -> str:
    if column in AUTHN_TEXTS:
        value = f"""COALESCE('"' || {column} || '"', 'null')"""
    elif column == "created":
        decimals = "rtrim(rtrim(strftime(created, '.%f'), '0'), '.')"
        value = f"""'"' || strftime(created, '%Y-%m-%dT%H:%M:%S') || {decimals} || '+00:00"'"""
    else:
        value = f"COALESCE(CAST({column} AS STRING), 'null')"
    return f"""'"{name}":' || {value}"""


@query(
    "d11_to_json",
    f"""SELECT event_id, '{{' || {" || ',' || ".join(_json_member(n, c) for n, c in {
        'sessionId': 'sessionid', 'externalSessionId': 'externalsessionid',
        'externalTokenIssuer': 'externaltokenissuer', 'created': 'created', 'userId': 'userid',
        'supplierId': 'supplierid', 'orgNumber': 'orgnumber', 'eventType': 'eventtypeid',
        'authenticationMethod': 'authenticationmethodid', 'authenticationLevel': 'authenticationlevelid',
        'ipAddress': 'ipaddress', 'isAuthenticated': 'isauthenticated', 'subscriptionKey': 'subscriptionkey',
    }.items())} || '}}' AS json FROM ({AUTHN})""",
)
def d11_to_json(spark, sf_dir):
    return authn_to_json(feeds.authn_events(spark, sf_dir)).select("event_id", "json")


# --- validation and references ------------------------------------------------


@query("e10_validate_authn", f"SELECT event_id AS msg_id, {AUTHN_OUTCOME} AS codes FROM ({AUTHN})")
def e10_validate_authn(spark, sf_dir):
    messages = feeds.stored(spark, sf_dir, "authn_messages")
    checked = check_authn(messages, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
    return checked.select("msg_id", _error_codes(F.col("errors")))


@query(
    "e10_validate_authz",
    f"SELECT event_id AS msg_id, {RAW_OUTCOME} AS codes FROM ({AUTHZ}) WHERE event_id % 8 <> 5",
)
def e10_validate_authz(spark, sf_dir):
    messages = feeds.stored(spark, sf_dir, "raw_messages")
    checked = check_authz(messages, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
    return checked.select("msg_id", _error_codes(F.col("errors")))


def _register_rule(name: str, kind: str, code: str, field: str) -> None:
    """Messages that break one rule, with the field the reason names."""
    source, readable, errors = (
        (AUTHN, AUTHN_READABLE, AUTHN_ERRORS) if kind == "authn" else (AUTHZ, AUTHZ_READABLE, AUTHZ_ERRORS)
    )
    broken = f"NOT ({readable})" if code == "not_object" else f"{readable} AND {errors.get(code)}"

    @query(name, f"SELECT event_id AS msg_id, '{field}' AS field FROM ({source}) WHERE {broken}")
    def rule(spark, sf_dir):
        dimensions, open_months = current_dimensions(spark), _catalog(spark, EVENTS_DAY)
        if kind == "authn":
            checked = check_authn(feeds.stored(spark, sf_dir, "authn_messages"), dimensions, open_months)
        else:
            documents = feeds.stored(spark, sf_dir, "authz_documents").withColumnRenamed("json", "body")
            checked = check_authz_documents(documents, dimensions, open_months)
        return checked.where(F.map_contains_key("errors", code)).select("msg_id", F.col("errors")[code].alias("field"))


_register_rule("e1_not_object", "authn", "not_object", "body")
_register_rule("e2_created_missing", "authn", "created_missing", "Created")
_register_rule("e3_operation_missing", "authz", "operation_missing", "Operation")
_register_rule("e4_context_not_object", "authz", "context_not_object", "ContextRequestJson")
_register_rule("e5_decision_missing", "authz", "decision_missing", "Decision")
_register_rule("e6_decision_range", "authz", "decision_range", "Decision")
_register_rule("e7_bad_int", "authn", "bad_int", "UserId")
_register_rule("e8_uuid_too_long", "authz", "uuid_too_long", "SubjectPartyUuid")


@query(
    "e9_not_null",
    f"""SELECT count(*) AS n_rows, count(*) AS n_created, count(*) AS n_isauthenticated
        FROM ({AUTHN}) WHERE {AUTHN_OUTCOME} = ''""",
)
def e9_not_null(spark, sf_dir):
    """Accepted events always have the two columns that may not be NULL."""
    messages = feeds.stored(spark, sf_dir, "authn_messages")
    checked = check_authn(messages, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
    return accepted(checked, "authn").agg(
        F.count("*").alias("n_rows"),
        F.count("created").alias("n_created"),
        F.count("isauthenticated").alias("n_isauthenticated"),
    )


def _register_reference_check(name: str, code: str, events_sql: str, column_sql: str) -> None:
    ref = lookups.reference(code)

    @query(
        name,
        f"""SELECT event_id, {column_sql} AS id FROM ({events_sql})
            WHERE {column_sql} NOT IN (SELECT id FROM {DIMENSION_SQL[ref.dimension]})""",
    )
    def check(spark, sf_dir):
        if code == "fk_decision":
            events = conform(feeds.authz_events(spark, sf_dir), "authz", ("event_id",))
        else:
            events = feeds.authn_events(spark, sf_dir)
        found = lookups.violators(events, ref, current_dimensions(spark)[ref.dimension])
        return found.select("event_id", F.col(ref.column).alias("id"))


_register_reference_check("c1_fk_eventtype", "fk_eventtype", AUTHN, "eventtypeid")
_register_reference_check("c2_fk_level", "fk_level", AUTHN, "authenticationlevelid")
_register_reference_check("c3_fk_method", "fk_method", AUTHN, "authenticationmethodid")
_register_reference_check("c4_fk_decision", "fk_decision", AUTHZ, "decision + 1")


@query(
    "c5_route",
    """SELECT o_orderkey,
          o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-10-01' AS has_partition
       FROM orders""",
)
def c5_route(spark, sf_dir):
    flagged = lookups.flag_unroutable(_orders(spark, sf_dir), _catalog(spark, ORDERS_DAY), v.AUTHN_SCHEMA)
    return flagged.select("o_orderkey", (~F.col("no_partition")).alias("has_partition"))


@query(
    "c6_decode_authn",
    f"""SELECT e.event_id, e.created, t.name AS eventtype, l.name AS authenticationlevel,
               m.name AS authenticationmethod
        FROM ({AUTHN}) e
        LEFT JOIN (SELECT * FROM {DIMENSION_SQL['authenticationeventtype']}) t ON t.id = e.eventtypeid
        LEFT JOIN (SELECT * FROM {DIMENSION_SQL['authenticationlevel']}) l ON l.id = e.authenticationlevelid
        LEFT JOIN (SELECT * FROM {DIMENSION_SQL['authenticationmethod']}) m ON m.id = e.authenticationmethodid""",
)
def c6_decode_authn(spark, sf_dir):
    named = lookups.decode_names(feeds.authn_events(spark, sf_dir), "authn", current_dimensions(spark))
    return named.select("event_id", _plain("created"), "eventtype", "authenticationlevel", "authenticationmethod")


@query(
    "c6_decode_authz",
    f"""SELECT e.event_id, e.decision + 1 AS decision, d.name AS decision_name
        FROM ({AUTHZ}) e
        LEFT JOIN (SELECT * FROM {DIMENSION_SQL['decision']}) d ON d.id = e.decision + 1""",
)
def c6_decode_authz(spark, sf_dir):
    events = conform(feeds.authz_events(spark, sf_dir), "authz", ("event_id",))
    named = lookups.decode_names(events, "authz", current_dimensions(spark))
    return named.select("event_id", "decision", "decision_name")


# --- partitions and retention -------------------------------------------------


@query(
    "f1_month_bounds",
    f"""SELECT o_orderkey, {MONTH.format('o_orderdate')} AS start_date,
        CAST({MONTH.format('o_orderdate')} + INTERVAL 1 MONTH AS DATE) AS end_date FROM orders""",
)
def f1_month_bounds(spark, sf_dir):
    day = F.col("created")
    return _orders(spark, sf_dir).select(
        "o_orderkey", months.month_start(day).alias("start_date"), months.month_end(day).alias("end_date")
    )


@query(
    "f2_partition_name",
    "SELECT o_orderkey, strftime(o_orderdate, 'eventlogv1_y%Ym%m') AS name FROM orders",
)
def f2_partition_name(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", months.partition_name(F.col("created")).alias("name"))


ORDER_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders)"


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(F.to_date("created").alias("as_of")).distinct()


@query(
    "f3_partition_plan",
    f"""SELECT as_of, {_describe_sql('m')} FROM (
          SELECT as_of, CAST({MONTH.format('as_of')} + INTERVAL 1 MONTH * n AS DATE) AS m
          FROM {ORDER_DAYS} d CROSS JOIN (VALUES (-1), (0), (1)) AS t(n)) p
        CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)""",
)
def f3_partition_plan(spark, sf_dir):
    """The plan of every day that has orders."""
    return partitions.plan_partitions(_order_days(spark, sf_dir), ("as_of",))


@query(
    "f4_create_missing",
    f"""{ORDER_MONTHS} UNION
        SELECT {_describe_sql('m')} FROM (
          SELECT CAST({MONTH.format('max(o_orderdate)')} + INTERVAL 1 MONTH AS DATE) AS m FROM orders
          UNION ALL SELECT CAST({MONTH.format('min(o_orderdate)')} - INTERVAL 1 MONTH AS DATE) FROM orders) p
        CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)""",
)
def f4_create_missing(spark, sf_dir):
    """List made by running the job on every day that has orders, starting with the months of fulfilled ones."""
    fulfilled = _orders(spark, sf_dir).where("o_orderstatus = 'F'")
    days = fulfilled.select(F.to_date("created").alias("as_of")).distinct()
    present = partitions.describe_months(days, F.col("as_of")).distinct()
    return partitions.create_missing(present, partitions.plan_partitions(_order_days(spark, sf_dir)))


@query(
    "f5_partitioned_write",
    f"""SELECT o_orderkey, o_orderdate AS created, {MONTH.format('o_orderdate')} AS created_month FROM orders""",
)
def f5_partitioned_write(spark, sf_dir):
    path = scratch_dir(spark, "f5") + "/orders"
    tables.append_events(_orders(spark, sf_dir), path, rebalance=True)
    return spark.read.parquet(path).select("o_orderkey", _plain("created"), "created_month")


ACCEPTED_AUTHN = f"SELECT {_select(_stored(AUTHN_PARSED, 'authn'))} FROM ({AUTHN}) WHERE {AUTHN_OUTCOME} = ''"


def _batches(spark: SparkSession, sf_dir: str, label: str, count: int) -> str:
    """Root of a table to which all authentication messages came in so many batches."""
    root = scratch_dir(spark, label) + "/authn"
    messages = feeds.stored(spark, sf_dir, "authn_messages")
    for n in range(count):
        part = messages.where(F.col("msg_id") % count == n)
        checked = check_authn(part, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
        tables.write_checked(checked, root, "authn", f"{n}", tried_before=False)
    return root


@query(
    "f5_compact",
    f"""SELECT sessionid, created, {MONTH.format('created')} AS created_month, 1 AS n_folders FROM ({ACCEPTED_AUTHN})""",
)
def f5_compact(spark, sf_dir):
    """Events in months joined from four batches, one of which was stored once more after that; and folders by month."""
    root = _batches(spark, sf_dir, "f5c", 4)
    compact(spark, root, "authn", grace=0)
    again = feeds.stored(spark, sf_dir, "authn_messages").where("msg_id % 4 = 1")
    tables.write_checked(check_authn(again, current_dimensions(spark), _catalog(spark, EVENTS_DAY)), root, "authn", "1")
    for _ in range(2):  # the second run deletes what the first has replaced
        compact(spark, root, "authn", grace=0)
    found = batches.paths(spark, root, "accepted")
    counted = spark.createDataFrame([(path.split("created_month=")[1][:10],) for path in found], "month string")
    counted = counted.groupBy(F.col("month").cast("date").alias("created_month")).agg(F.count("*").cast("int").alias("n_folders"))
    events = tables.read_accepted(spark, root, "authn").select("sessionid", _plain("created"), "created_month")
    return events.join(F.broadcast(counted), "created_month")


@query(
    "f6_cutoff",
    f"""SELECT o_orderkey,
          CAST({MONTH.format('o_orderdate')} - INTERVAL 1 MONTH * CAST(o_orderkey % 25 AS INTEGER) AS DATE) AS cutoff
        FROM orders""",
)
def f6_cutoff(spark, sf_dir):
    keep = (F.col("o_orderkey") % 25).cast("int")
    return _orders(spark, sf_dir).select(
        "o_orderkey", months.retention_cutoff(F.to_date("created"), keep).alias("cutoff")
    )


RETENTIONS = (0, 1, 2, 3, 22, 23, 24)


@query(
    "f7_partitions_to_drop",
    f"""SELECT as_of, retention_months, {_describe_sql('m')} FROM (
          SELECT as_of, retention_months, CAST({MONTH.format('as_of')} - INTERVAL 1 MONTH * n AS DATE) AS m
          FROM {ORDER_DAYS} d
          CROSS JOIN (VALUES {', '.join(f'({n})' for n in RETENTIONS)}) AS r(retention_months)
          CROSS JOIN range(0, 24) AS b(n)
          WHERE n > retention_months) p
        CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)""",
)
def f7_partitions_to_drop(spark, sf_dir):
    """Drop lists of every day that has orders, for several retention times."""
    kept = F.explode(F.array(*[F.lit(n) for n in RETENTIONS]))
    days = _order_days(spark, sf_dir).withColumn("retention_months", kept)
    return partitions.partitions_to_drop(days, F.col("retention_months"), ("as_of", "retention_months"))


@query(
    "f8_drop_partitions",
    f"""SELECT o_orderkey, {MONTH.format('o_orderdate')} AS created_month FROM orders
        WHERE o_orderdate < TIMESTAMP '1999-09-01' OR o_orderdate >= TIMESTAMP '2001-06-01'""",
)
def f8_drop_partitions(spark, sf_dir):
    """Rows left in a table after a maintenance run that keeps two months: the look-back ends in 1999."""
    root = scratch_dir(spark, "f8")
    tables.append_events(_orders(spark, sf_dir), f"{root}/orders", rebalance=True)
    save_catalog(_order_months(spark, sf_dir), f"{root}/catalog")
    run_maintenance(spark, f"{root}/catalog", {"authn": f"{root}/orders"}, ORDERS_DAY, True, 2)
    return spark.read.parquet(f"{root}/orders").select("o_orderkey", "created_month")


@query(
    "f8_drop_refused",
    f"""SELECT msg_id, codes, CAST(TIMESTAMP '2024-01-15' - INTERVAL 1 MONTH * CAST(msg_id % 6 AS INTEGER) AS TIMESTAMP) AS arrived
        FROM (SELECT event_id AS msg_id, {AUTHN_OUTCOME} AS codes FROM ({AUTHN})) WHERE codes <> '' AND msg_id % 6 <= 2""",
)
def f8_drop_refused(spark, sf_dir):
    """Refused messages left after a run that keeps two months of them; each came up to five months before."""
    root = scratch_dir(spark, "f8r")
    messages = feeds.stored(spark, sf_dir, "authn_messages")
    checked = check_authn(messages, current_dimensions(spark), _catalog(spark, EVENTS_DAY))
    arrived = F.add_months(F.lit(EVENTS_DAY), -(F.col("msg_id") % 6).cast("int")).cast("timestamp")
    tables.write_checked(checked, f"{root}/authn", "authn", "feed", arrived=arrived)
    run_maintenance(spark, f"{root}/catalog", {}, EVENTS_DAY, True, 24, refused=[f"{root}/authn"], refused_months=2)
    left = tables.read_quarantine(spark, f"{root}/authn")
    return left.select("msg_id", _error_codes(F.col("errors")), _plain("arrived"))


@query(
    "f9_maintain",
    f"""SELECT * FROM ({ORDER_MONTHS}) WHERE start_date < DATE '1999-09-01' OR end_date > DATE '2001-06-01'
        UNION
        SELECT {_describe_sql('m')}
        FROM (VALUES (DATE '2001-07-01'), (DATE '2001-08-01'), (DATE '2001-09-01')) AS p(m)
        CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)""",
)
def f9_maintain(spark, sf_dir):
    root = scratch_dir(spark, "f9") + "/catalog"
    save_catalog(_order_months(spark, sf_dir), root)
    run_maintenance(spark, root, {}, ORDERS_DAY, enabled=True, retention_months=2)
    return load_catalog(spark, root)


@query(
    "f9_side_by_side",
    f"""SELECT DISTINCT {_describe_sql('m')} FROM (
          SELECT CAST({MONTH.format('d')} + INTERVAL 1 MONTH * n AS DATE) AS m
          FROM (SELECT unnest([min(o_orderdate), max(o_orderdate) FILTER (o_orderstatus = 'F'), max(o_orderdate)]) AS d FROM orders)
          CROSS JOIN (VALUES (-1), (0), (1)) AS t(n)) p
        CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)""",
)
def f9_side_by_side(spark, sf_dir):
    """The list after maintenance runs for the first and last day with orders and the last with fulfilled ones, all at once."""
    root = scratch_dir(spark, "f9s") + "/catalog"
    day, fulfilled = F.to_date("created"), F.col("o_orderstatus") == "F"
    days = list(_orders(spark, sf_dir).agg(F.min(day), F.max(F.when(fulfilled, day)), F.max(day)).first())
    with ThreadPoolExecutor(len(days)) as runs:
        list(runs.map(lambda day: run_maintenance(spark, root, {}, day), days))
    return load_catalog(spark, root)


@query(
    "f11_partition_exists",
    """SELECT schema_name, name, start_date, end_date FROM (
         SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date FROM orders) d
       CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)
       CROSS JOIN LATERAL (SELECT strftime(start_date, 'eventlogv1_y%Ym%m') AS name,
                                  CAST(start_date + INTERVAL 1 MONTH AS DATE) AS end_date) n
       WHERE start_date BETWEEN DATE '2001-07-01' AND DATE '2001-09-01'""",
)
def f11_partition_exists(spark, sf_dir):
    """Which of the months with orders have a partition after one run of the job."""
    after = maintain(partitions.empty_catalog(spark), ORDERS_DAY)
    return partitions.existing(_order_months(spark, sf_dir), after)


@query(
    "f12_yearly_chunks",
    "SELECT o_orderkey, o_orderdate AS created, CAST(year(o_orderdate) AS INTEGER) AS created_year FROM orders",
)
def f12_yearly_chunks(spark, sf_dir):
    path = scratch_dir(spark, "f12") + "/orders"
    tables.rewrite_by_year(_orders(spark, sf_dir), path)
    return spark.read.parquet(path).select("o_orderkey", _plain("created"), "created_year")


# --- older layouts and reading back -------------------------------------------


@query(
    "g1_add_column",
    f"""SELECT NULLIF(sessionid, '') AS sessionid, created, NULLIF(subject_party_uuid, '') AS subject_party_uuid
        FROM ({AUTHZ})
        UNION ALL SELECT NULLIF(sessionid, ''), created, NULL FROM ({AUTHZ})""",
)
def g1_add_column(spark, sf_dir):
    """One table with files from before and after a column was added, read as one."""
    path = scratch_dir(spark, "g1") + "/events"
    events = conform(feeds.authz_events(spark, sf_dir), "authz")
    tables.append_events(events.drop("subject_party_uuid"), path)
    tables.append_events(events, path)
    return tables.read_events(spark, path, "authz").select("sessionid", _plain("created"), "subject_party_uuid")


@query(
    "g2_union_versions",
    f"""SELECT created, operation, decision, subject_party_uuid
        FROM (SELECT {_select(_stored(AUTHZ_TYPED, 'authz'))} FROM ({AUTHZ}))
        UNION ALL
        SELECT created, operation, decision, NULL
        FROM (SELECT {_select(_stored(AUTHZ_TYPED, 'authz'))} FROM ({AUTHZ}))""",
)
def g2_union_versions(spark, sf_dir):
    root = scratch_dir(spark, "g2")
    events = conform(feeds.authz_events(spark, sf_dir), "authz")
    tables.rewrite_by_year(events.drop("subject_party_uuid"), f"{root}/eventlog")
    tables.append_events(events, f"{root}/eventlogv1")
    old = tables.read_first_generation(spark, f"{root}/eventlog", "authz")
    new = tables.read_events(spark, f"{root}/eventlogv1", "authz").drop("created_month")
    both = readouts.union_generations(old, new)
    return both.select(_plain("created"), "operation", "decision", "subject_party_uuid")


@query(
    "g2_union_authn",
    f"""SELECT {_select(_stored(AUTHN_TYPED, 'authn'))} FROM ({AUTHN}) CROSS JOIN (VALUES (1), (2)) AS twice(n)""",
)
def g2_union_authn(spark, sf_dir):
    """The first generation of the authentication table, by year, and the present one, by month, as one."""
    root = scratch_dir(spark, "g2n")
    events = conform(feeds.authn_events(spark, sf_dir), "authn")
    tables.rewrite_by_year(events, f"{root}/eventlog")
    tables.append_events(events, f"{root}/eventlogv1")
    old = tables.read_first_generation(spark, f"{root}/eventlog", "authn")
    new = tables.read_events(spark, f"{root}/eventlogv1", "authn").drop("created_month")
    return _plain_events(readouts.union_generations(old, new), AUTHN_COLUMNS)


@query(
    "g2_generations",
    f"""SELECT created, partyuuid, subjectparty, address FROM (
          SELECT created, NULL AS partyuuid, CAST(subjectparty AS BIGINT) AS subjectparty, ipaddress AS address FROM ({AUTHZ})
          UNION ALL SELECT created, subject_party_uuid, subjectparty, ipaddress FROM ({AUTHZ})
          UNION ALL SELECT created, subject_party_uuid, subjectparty + 10000000000, ipaddress FROM ({AUTHZ}))""",
)
def g2_generations(spark, sf_dir):
    """Three generations in one folder: before a column came, with it, and with two renamed and one widened."""
    path = scratch_dir(spark, "g2g") + "/events"
    table = Registry({"created": "timestamp", "subjectparty": "int", "ipaddress": "string"})
    events = feeds.authz_events(spark, sf_dir)
    append_generation(events, path, table.newest)
    append_generation(events, path, table.with_column("subject_party_uuid", "string"))
    table.add(table.newest.renamed(subject_party_uuid="partyuuid", ipaddress="address").widened(subjectparty="bigint"))
    wide = F.col("subjectparty") + F.lit(10000000000)
    later = events.withColumnsRenamed({"subject_party_uuid": "partyuuid", "ipaddress": "address"}).withColumn("subjectparty", wide)
    append_generation(later, path, table.newest)
    return read_generation(spark, path, table.newest).select(_plain("created"), "partyuuid", "subjectparty", "address")


@query(
    "h1_time_range_scan",
    """SELECT o_orderkey, o_orderdate AS created FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-03-10' AND o_orderdate < TIMESTAMP '1997-06-05 12:00:00'""",
)
def h1_time_range_scan(spark, sf_dir):
    path = scratch_dir(spark, "h1") + "/orders"
    orders = _orders(spark, sf_dir)
    tables.append_events(orders, path, rebalance=True)
    found = tables.read_range(spark, path, orders.schema, dt.datetime(1997, 3, 10), dt.datetime(1997, 6, 5, 12))
    return found.select("o_orderkey", _plain("created"))


@query(
    "h1_zone_range",
    f"""SELECT sessionid, created, created_month, less_than_all FROM (
          SELECT sessionid, created, {MONTH.format('created')} AS created_month, TRUE AS less_than_all FROM ({ACCEPTED_AUTHN}))
        WHERE created >= TIMESTAMP '2024-01-11 06:00:00' AND created < TIMESTAMP '2024-01-11 18:00:00'""",
)
def h1_zone_range(spark, sf_dir):
    """Half a day of a month that was joined into eight files, and whether fewer files than there are were read for it."""
    root = _batches(spark, sf_dir, "h1z", 2)
    size = sum(folders.size(spark, path) for path in batches.paths(spark, root, "accepted", month="2024-01-01"))
    compact(spark, root, "authn", file_bytes=max(1, size // 8), grace=0)
    found = tables.read_accepted_range(spark, root, "authn", dt.datetime(2024, 1, 11, 6), dt.datetime(2024, 1, 11, 18))
    there = zones.files(spark, root, "2024-01-01")
    fewer = F.lit(len(found.inputFiles()) < len(there)).alias("less_than_all")
    return found.select("sessionid", _plain("created"), "created_month", fewer)


@query(
    "h2_stored_stats",
    f"""SELECT c.schema_name, c.name, c.start_date, c.end_date, count(e.created) AS n_rows,
               min(e.created) AS first_created, max(e.created) AS last_created
        FROM (SELECT {_describe_sql('m')}
              FROM (VALUES (DATE '2023-12-01'), (DATE '2024-01-01'), (DATE '2024-02-01')) AS p(m)
              CROSS JOIN (VALUES ('authentication'), ('authz')) AS s(schema_name)) c
        LEFT JOIN ({ACCEPTED_AUTHN}) e
          ON c.schema_name = 'authentication' AND {MONTH.format('e.created')} = c.start_date
        GROUP BY ALL""",
)
def h2_stored_stats(spark, sf_dir):
    """Statistics from what was noted when files were written, after a replay and joining; no event is read for them."""
    root = _batches(spark, sf_dir, "h2s", 2)
    again = feeds.stored(spark, sf_dir, "authn_messages").where("msg_id % 2 = 1")
    tables.write_checked(check_authn(again, current_dimensions(spark), _catalog(spark, EVENTS_DAY)), root, "authn", "1")
    compact(spark, root, "authn")
    stats = tables.stored_stats(spark, {"authn": root}, _catalog(spark, EVENTS_DAY))
    return stats.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_created", "last_created")})


@query(
    "h2_partition_stats",
    f"""SELECT c.schema_name, c.name, c.start_date, c.end_date, count(o.o_orderkey) AS n_rows,
               min(o.o_orderdate) AS first_created, max(o.o_orderdate) AS last_created
        FROM ({ORDER_MONTHS} UNION
              SELECT s.schema_name, 'eventlogv1_y2002m01', DATE '2002-01-01', DATE '2002-02-01'
              FROM (VALUES ('authentication'), ('authz')) AS s(schema_name)) c
        LEFT JOIN (SELECT 'authentication' AS kind, o_orderkey, o_orderdate FROM orders
                   UNION ALL
                   SELECT 'authz', o_orderkey, o_orderdate + INTERVAL 45 DAY FROM orders WHERE o_orderstatus <> 'O') o
          ON o.kind = c.schema_name AND {MONTH.format('o.o_orderdate')} = c.start_date
        GROUP BY ALL""",
)
def h2_partition_stats(spark, sf_dir):
    empty = partitions.describe_months(partitions.on_day(spark, dt.date(2002, 1, 1)), F.col("as_of"))
    catalog = _order_months(spark, sf_dir).unionByName(empty)
    orders = _orders(spark, sf_dir).select("created", "o_orderstatus")
    later = orders.where("o_orderstatus <> 'O'").withColumn("created", F.expr("created + INTERVAL 45 DAYS"))
    events = readouts.with_partition(orders, "authn").unionByName(readouts.with_partition(later, "authz"))
    stats = readouts.partition_stats(events, catalog)
    return stats.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_created", "last_created")})


def _flat(category: str, attribute: str, value: str) -> str:
    return f"SELECT event_id, '{category}' AS category, {attribute} AS attribute_id, {value} AS value FROM ({AUTHZ})"


@query(
    "h3_context_flatten",
    " UNION ALL ".join(
        [
            _flat(feeds.SUBJECT, "'urn:example:userid'", "CAST(user_id AS STRING)"),
            _flat(feeds.SUBJECT, "'urn:example:rolecode'", "'dagl'"),
            _flat(feeds.SUBJECT, "'urn:example:rolecode'", "'r' || CAST(k % 3 AS STRING)"),
            _flat(feeds.ACTION, "'urn:oasis:names:tc:xacml:1.0:action:action-id'", "event_type"),
            _flat(feeds.RESOURCE, "'urn:example:resource'", "'res_' || CAST(k % 10 AS STRING)"),
            _flat(feeds.ENVIRONMENT, "NULL", "NULL"),
        ]
    ),
)
def h3_context_flatten(spark, sf_dir):
    """From events as they are stored, with typed columns beside the request."""
    flat = flatten_stored(feeds.stored(spark, sf_dir, "authz_table"), ("event_id",))
    return flat.select("event_id", "category", "attribute_id", "value")


@query("h3_context_variant", ORACLES["h3_context_flatten"])
def h3_context_variant(spark, sf_dir):
    """From the request itself, as in files without typed columns."""
    flat = readouts.flatten_context(feeds.stored(spark, sf_dir, "authz_table"), ("event_id",))
    return flat.select("event_id", "category", "attribute_id", "value")


# --- continuous ingest --------------------------------------------------------


def _stream(spark: SparkSession, path: str, kind: str, day: dt.date, times: int = 1) -> str:
    """Ingest all messages below a folder through as many streams into one root; returns the root of the tables."""
    root = scratch_dir(spark, f"stream-{kind}")
    save_catalog(_catalog(spark, day), f"{root}/catalog")
    dimensions = current_dimensions(spark)
    running = [
        start_ingest(
            read_messages(spark, path, kind, streaming=True),
            kind,
            f"{root}/events",
            f"{root}/state-{n}",
            lambda: dimensions,
            lambda: load_catalog(spark, f"{root}/catalog"),
            name=f"{kind}-{n}-{uuid.uuid4().hex}",
            trigger={"availableNow": True},
        )
        for n in range(times)
    ]
    for stream in running:
        stream.awaitTermination()
    return f"{root}/events"


@query(
    "s1_stream_authn",
    f"""SELECT {_select(_stored(AUTHN_PARSED, 'authn'))}, {MONTH.format('created')} AS created_month
        FROM (SELECT * FROM ({AUTHN}) WHERE {AUTHN_OUTCOME} = '') CROSS JOIN (VALUES (1), (2)) AS twice(n)""",
)
def s1_stream_authn(spark, sf_dir):
    """Two streams with checkpoints of their own, side by side into one root."""
    root = _stream(spark, feeds.stored_path(spark, sf_dir, "authn_messages"), "authn", EVENTS_DAY, 2)
    return _plain_events(tables.read_accepted(spark, root, "authn"), AUTHN_COLUMNS, "created_month")


@query(
    "s2_stream_authz",
    f"""SELECT {_select(_stored(AUTHZ_PARSED, 'authz') | CONTEXT_READS)}, {MONTH.format('created')} AS created_month
        FROM (SELECT * FROM ({AUTHZ}) WHERE event_id % 8 <> 5 AND {RAW_OUTCOME} = '')
        CROSS JOIN (VALUES (1), (2)) AS twice(n)""",
)
def s2_stream_authz(spark, sf_dir):
    """Two streams with checkpoints of their own, side by side into one root."""
    root = _stream(spark, feeds.stored_path(spark, sf_dir, "raw_messages"), "authz", EVENTS_DAY, 2)
    stored = tables.read_accepted(spark, root, "authz")
    return _plain_events(stored, AUTHZ_COLUMNS, "created_month", *_context_reads())


@query("s1_queue_authn", ACCEPTED_AUTHN)
def s1_queue_authn(spark, sf_dir):
    """A stream from a queue to which messages are sent eight times, stopped and started again half-way."""
    root = scratch_dir(spark, "queue")
    save_catalog(_catalog(spark, EVENTS_DAY), f"{root}/catalog")
    dimensions, messages = current_dimensions(spark), feeds.stored(spark, sf_dir, "authn_messages")
    for n in range(8):
        send(messages.where(F.col("msg_id") % 8 == n), f"{root}/queue")
        if n % 4 == 3:
            start_ingest(
                read_queue(spark, f"{root}/queue", "authn", streaming=True),
                "authn",
                f"{root}/events",
                f"{root}/state",
                lambda: dimensions,
                lambda: load_catalog(spark, f"{root}/catalog"),
                trigger={"availableNow": True},
            ).awaitTermination()
    return _plain_events(tables.read_accepted(spark, f"{root}/events", "authn"), AUTHN_COLUMNS)


@query(
    "s3_acceptance_window",
    """SELECT o_orderkey AS msg_id,
          o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-10-01' AS accepted
       FROM orders""",
)
def s3_acceptance_window(spark, sf_dir):
    """Events as old as the orders: those without a partition are refused for just that."""
    path = scratch_dir(spark, "s3") + "/messages"
    body = F.concat(
        F.lit('{"EventType":"Logout","SessionId":"'),
        F.col("o_orderkey").cast("string"),
        F.lit('","Created":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('Z"}'),
    )
    _orders(spark, sf_dir).select(F.col("o_orderkey").alias("msg_id"), body.alias("body")).write.parquet(path)
    root = _stream(spark, path, "authn", ORDERS_DAY)
    kept = tables.read_accepted(spark, root, "authn")
    refused = tables.read_quarantine(spark, root).where("map_keys(errors) = array('no_partition')")
    return kept.select(F.col("sessionid").cast("bigint").alias("msg_id"), F.lit(True).alias("accepted")).unionByName(
        refused.select("msg_id", F.lit(False).alias("accepted"))
    )
