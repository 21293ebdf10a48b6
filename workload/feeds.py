"""Message feeds and typed events derived from the ``events``, ``orders`` and ``documents`` tables.

Feeds are written in the part of SQL that Spark and the checking engine share,
so that expected results can start from the same rows; the few spellings that
differ are in ``SPARK`` and ``CHECKER``.  ``k`` is the number from 0 to 99 in an
event's ``props``; values of 80 and above mark deliberately odd messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewire import vocabulary as v
from gatewire.functions.brotli import brotli_compress
from gatewire.operators.shred import shredded
from gatewire.session import scratch_dir

SPARK = {
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "iso": "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "hours": "{} + INTERVAL '2' HOUR",
}
CHECKER = {
    "k": "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)",
    "iso": "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')",
    "hours": "{} + INTERVAL 2 HOUR",
}

STRING_TYPE = "http://www.w3.org/2001/XMLSchema#string"
SUBJECT = "urn:oasis:names:tc:xacml:1.0:subject-category:access-subject"
ACTION = "urn:oasis:names:tc:xacml:3.0:attribute-category:action"
RESOURCE = "urn:oasis:names:tc:xacml:3.0:attribute-category:resource"
ENVIRONMENT = "urn:oasis:names:tc:xacml:3.0:attribute-category:environment"

# Typed authentication events. Event type 0, method 23 and level 5 have no lookup row.
AUTHN_EVENTS = """
    SELECT
      event_id,
      k,
      's-' || CAST(event_id AS STRING) AS sessionid,
      CASE WHEN k % 7 = 0 THEN '' ELSE 'x-' || CAST(k AS STRING) END AS externalsessionid,
      CASE WHEN k % 5 = 0 THEN NULL ELSE 'key' || CAST(k AS STRING) END AS subscriptionkey,
      CASE WHEN k % 3 = 0 THEN ' ' ELSE 'issuer' END AS externaltokenissuer,
      ts AS created,
      CAST(user_id AS INT) AS userid,
      CASE WHEN event_type = 'purchase' THEN 'sup-' || CAST(k AS STRING) ELSE '' END AS supplierid,
      CASE WHEN k % 4 = 0 THEN CAST(900000000 + k AS INT) END AS orgnumber,
      CAST(CASE event_type
        WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS INT)
        AS eventtypeid,
      CAST(k % 25 - 1 AS INT) AS authenticationmethodid,
      CAST(k % 6 AS INT) AS authenticationlevelid,
      CASE WHEN k < 10 THEN '' ELSE '192.0.2.' || CAST(k AS STRING) END AS ipaddress,
      event_type <> 'error' AS isauthenticated
    FROM (SELECT *, {k} AS k FROM events)
"""

# Typed authorization events, decision as on the wire (4 is out of range).
AUTHZ_EVENTS = """
    SELECT
      event_id,
      k,
      user_id,
      event_type,
      CASE WHEN k % 5 = 0 THEN '' ELSE 's-' || CAST(event_id AS STRING) END AS sessionid,
      ts AS created,
      CAST(user_id AS INT) AS subjectuserid,
      CASE WHEN k % 4 = 0 THEN '' ELSE 'org' || CAST(k % 5 AS STRING) END AS subjectorgcode,
      CASE WHEN k % 3 = 0 THEN CAST(910000000 + k AS INT) END AS subjectorgnumber,
      CAST(50000000 + user_id AS INT) AS subjectparty,
      CAST(1000 + k AS INT) AS resourcepartyid,
      'res_' || CAST(k % 10 AS STRING) AS resource,
      CASE WHEN k % 6 = 0 THEN '' ELSE CAST(1000 + k AS STRING) || '/' || CAST(event_id AS STRING) END
        AS instanceid,
      CASE WHEN k = 7 THEN '' ELSE event_type END AS operation,
      CASE WHEN k < 10 THEN '' ELSE '192.0.2.' || CAST(k AS STRING) END AS ipaddress,
      CAST(k % 5 AS INT) AS decision,
      CASE WHEN k % 9 = 0 THEN '' ELSE 'uuid-' || CAST(event_id AS STRING) END AS subject_party_uuid
    FROM (SELECT *, {k} AS k FROM events)
"""


def _case(column: str, names: dict[str, int], otherwise: str) -> str:
    arms = " ".join(f"""WHEN {number} THEN '"{name}"'""" for name, number in names.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def _text(column: str) -> str:
    return f"""COALESCE('"' || {column} || '"', 'null')"""


def _number(column: str) -> str:
    return f"COALESCE(CAST({column} AS STRING), 'null')"


def authn_messages_sql(dialect: dict[str, str]) -> str:
    """``msg_id, body`` and the columns of AUTHN_EVENTS: JSON as queued, names and numbers mixed."""
    iso, shifted = dialect["iso"].format("created"), dialect["iso"].format(dialect["hours"].format("created"))
    event_type = (
        "CASE eventtypeid WHEN 1 THEN '\"Authenticate\"' WHEN 2 THEN '\"REFRESH\"' WHEN 4 THEN '\"logout\"'"
        " ELSE CAST(eventtypeid AS STRING) END"
    )
    method = (
        f"CASE WHEN k % 2 = 0 THEN {_number('authenticationmethodid')} ELSE "
        f"{_case('authenticationmethodid', v.WIRE_AUTHENTICATION_METHOD, _number('authenticationmethodid'))} END"
    )
    level = _case("authenticationlevelid", v.WIRE_SECURITY_LEVEL, _number("authenticationlevelid"))
    document = f"""
      CASE WHEN k = 99 THEN '{{"UserId":-1,' ELSE '{{' END
      || CASE WHEN k = 86 THEN '"SessionId":5' ELSE '"SessionId":' || {_text('sessionid')} END
      || ',"ExternalSessionId":' || {_text('externalsessionid')}
      || ',"SubscriptionKey":' || {_text('subscriptionkey')}
      || ',"ExternalTokenIssuer":' || {_text('externaltokenissuer')}
      || CASE k
           WHEN 92 THEN ''
           WHEN 85 THEN ',"Created":"yesterday"'
           WHEN 84 THEN ',"Created":"' || {shifted} || '+02:00"'
           WHEN 83 THEN ',"Created":"' || {iso} || '"'
           ELSE ',"Created":"' || {iso} || 'Z"' END
      || CASE k
           WHEN 93 THEN ',"UserId":"' || {_number('userid')} || '"'
           WHEN 94 THEN ',"UserId":1.5'
           WHEN 95 THEN ',"UserId":3000000000'
           WHEN 97 THEN ',"userid":' || {_number('userid')}
           ELSE ',"UserId":' || {_number('userid')} END
      || ',"SupplierId":' || {_text('supplierid')}
      || ',"OrgNumber":' || {_number('orgnumber')}
      || CASE k WHEN 89 THEN '' WHEN 96 THEN ',"EventType":"Unknown"' ELSE ',"EventType":' || {event_type} END
      || ',"AuthenticationMethod":' || {method}
      || ',"AuthenticationLevel":' || {level}
      || ',"IpAddress":' || {_text('ipaddress')}
      || CASE k
           WHEN 88 THEN ''
           WHEN 98 THEN ',"IsAuthenticated":null'
           ELSE ',"IsAuthenticated":' || CASE WHEN isauthenticated THEN 'true' ELSE 'false' END END
      || ',"TimeToDelete":"2031-05-06T07:08:09"'
      || CASE k WHEN 91 THEN '' WHEN 87 THEN '}} extra' ELSE '}}' END
    """
    return f"""
      SELECT event_id AS msg_id, CASE WHEN k = 90 THEN 'null' ELSE {document} END AS body, e.*
      FROM ({AUTHN_EVENTS.format(**dialect)}) e
    """


def context_sql() -> str:
    """The access request of an event as JSON text, from user_id, event_type and k."""

    def attribute(name: str, *values: str) -> str:
        items = " || ',' || ".join(
            f"""'{{"Value":"' || {x} || '","DataType":"{STRING_TYPE}","Attributes":[],"Elements":[]}}'"""
            for x in values
        )
        return (
            f"""'{{"Issuer":null,"AttributeId":"{name}","IncludeInResult":false,"AttributeValues":['"""
            f""" || {items} || ']}}'"""
        )

    def category(name: str, *attributes: str) -> str:
        inner = " || ',' || ".join(attributes) or "''"
        return f"""'{{"Id":null,"Content":null,"Category":"{name}","Attributes":[' || {inner} || ']}}'"""

    user = "CAST(user_id AS STRING)"
    parts = [
        category(
            SUBJECT,
            attribute("urn:example:userid", user),
            attribute("urn:example:rolecode", "'dagl'", "'r' || CAST(k % 3 AS STRING)"),
        ),
        category(ACTION, attribute("urn:oasis:names:tc:xacml:1.0:action:action-id", "event_type")),
        category(RESOURCE, attribute("urn:example:resource", "'res_' || CAST(k % 10 AS STRING)")),
        category(ENVIRONMENT),
    ]
    return (
        """'{"ReturnPolicyIdList":false,"CombinedDecision":false,"XPathVersion":null,"Attributes":[' || """
        + " || ',' || ".join(parts)
        + """ || '],"RequestReferences":[]}'"""
    )


def authz_documents_sql(dialect: dict[str, str]) -> str:
    """``msg_id, json`` and the columns of AUTHZ_EVENTS: documents in three key spellings."""
    iso = dialect["iso"].format("created")
    quote = "chr(34)"
    escaped = f"{quote} || replace(context, {quote}, chr(92) || {quote}) || {quote}"
    decision = _case("decision", v.WIRE_DECISION, _number("decision"))

    def integer(column: str) -> str:
        number = _number(column)
        return f"CASE WHEN k % 2 = 0 AND {column} IS NOT NULL THEN '\"' || {number} || '\"' ELSE {number} END"

    def document(spell) -> str:
        def key(name: str) -> str:
            return f"""',"{spell(name)}":' || """

        return f"""
          '{{"{spell('SessionId')}":' || {_text('sessionid')}
          || CASE WHEN k = 92 THEN '' ELSE {key('Created')} '"' || {iso} || 'Z"' END
          || {key('SubjectUserId')} CASE WHEN k = 97 THEN '1.5' ELSE {integer('subjectuserid')} END
          || {key('SubjectOrgCode')} {_text('subjectorgcode')}
          || {key('SubjectOrgNumber')} {integer('subjectorgnumber')}
          || {key('SubjectParty')} {integer('subjectparty')}
          || {key('ResourcePartyId')} {integer('resourcepartyid')}
          || {key('Resource')} {_text('resource')}
          || {key('InstanceId')} {_text('instanceid')}
          || CASE WHEN k = 93 THEN '' ELSE {key('Operation')} {_text('operation')} END
          || {key('TimeToDelete')} '"2031-05-06T07:08:09"'
          || {key('IpAdress')} {_text('ipaddress')}
          || {key('ContextRequestJson')}
               CASE WHEN k = 94 THEN '[1]' WHEN k = 89 THEN '"no json"' WHEN k % 4 = 1 THEN {escaped} ELSE context END
          || CASE k
               WHEN 95 THEN ''
               WHEN 99 THEN {key('Decision')} '"Maybe"'
               WHEN 88 THEN {key('Decision')} '2147483647'
               WHEN 87 THEN {key('Decision')} '"Permit","DECISION":"deny"'
               ELSE {key('Decision')} {decision} END
          || {key('SubjectPartyUuid')}
               CASE WHEN k = 98 THEN '"' || repeat('u', 256) || '"' ELSE {_text('subject_party_uuid')} END
          || CASE WHEN k = 91 THEN '' ELSE '}}' END
        """

    def camel(name: str) -> str:
        return name[0].lower() + name[1:]

    return f"""
      SELECT
        event_id AS msg_id,
        CASE
          WHEN k = 90 THEN 'null'
          WHEN k % 3 = 0 THEN {document(camel)}
          WHEN k % 3 = 1 THEN {document(str.lower)}
          ELSE {document(str)} END AS json,
        e.*
      FROM (SELECT e.*, {context_sql()} AS context FROM ({AUTHZ_EVENTS.format(**dialect)}) e) e
    """


def _run(spark: SparkSession, sf_dir: str, sql: str, tasks: int | None = None) -> DataFrame:
    """Run feed SQL straight on the Parquet files, without leaving views behind.

    With ``tasks`` the events are dealt to as many before anything is made of them: messages are many times as wide.
    """
    source = f"parquet.`{sf_dir}/events.parquet`"
    if tasks:
        source = f"(SELECT /*+ REPARTITION({tasks}) */ * FROM {source})"
    return spark.sql(sql.replace("FROM events", f"FROM {source}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def authn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed authentication events with ``event_id`` and ``k``."""
    events = _run(spark, sf_dir, AUTHN_EVENTS.format(**SPARK))
    return events.withColumn("created", F.col("created").cast("timestamp"))


def authn_messages(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    return _run(spark, sf_dir, authn_messages_sql(SPARK), tasks).select("msg_id", "body")


def authz_events(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Typed authorization events with ``event_id`` and ``k``; the context as VARIANT."""
    sql = f"SELECT e.*, {context_sql()} AS context FROM ({AUTHZ_EVENTS.format(**SPARK)}) e"
    return (
        _run(spark, sf_dir, sql, tasks)
        .withColumn("created", F.col("created").cast("timestamp"))
        .withColumn("contextrequestjson", F.parse_json("context"))
    )


def authz_documents(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``msg_id, json``: authorization events as posted directly."""
    return _run(spark, sf_dir, authz_documents_sql(SPARK), tasks).select("msg_id", "json")


def raw_messages(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``msg_id, body``: every document of ``authz_documents`` in one of eight envelopes.

    By ``msg_id % 8``: plain, base64, compressed, base64 of compressed, unknown
    version, one byte only, blank in front, compressed and cut short.
    """
    document = F.col("json").cast("binary")
    envelope = F.col("msg_id") % 8
    compressed = F.concat(F.lit(b"01"), F.col("_packed"))

    def one_line(data: Column) -> Column:
        return F.regexp_replace(F.base64(data), "[\r\n]", "").cast("binary")

    body = (
        F.when(envelope == 0, document)
        .when(envelope == 1, one_line(document))
        .when(envelope == 2, compressed)
        .when(envelope == 3, one_line(compressed))
        .when(envelope == 4, F.concat(F.lit(b"99"), document))
        .when(envelope == 5, F.lit(b"{"))
        .when(envelope == 6, F.concat(F.lit(b" "), document))
        .otherwise(F.substring(compressed, F.lit(1), F.length(compressed) - 5))
    )
    return (
        authz_documents(spark, sf_dir, tasks)
        .withColumn("_packed", brotli_compress(F.when(envelope.isin(2, 3, 7), document)))
        .select("msg_id", body.alias("body"))
    )


def authz_table(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Typed authorization events with the columns that are stored beside the request."""
    return authz_events(spark, sf_dir, tasks).withColumns(shredded("authz"))


def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, body``: whole texts as base64; of ten some with a foreign character, a group cut, or line breaks."""
    encoded, case = F.base64(F.col("text").cast("binary")), F.col("doc_id") % 10
    body = (
        F.when(case == 3, F.concat(encoded, F.lit("*===")))
        .when(case == 4, F.concat(encoded, F.lit("QUJ")))
        .when(case == 5, F.regexp_replace(encoded, "(.{60})", "$1\n"))
        .otherwise(encoded)
    )
    return table(spark, sf_dir, "documents").select("doc_id", body.cast("binary").alias("body"))


def brotli_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, payload``: whole texts, compressed; one in ten lacks its end."""
    packed = table(spark, sf_dir, "documents").select("doc_id", brotli_compress(F.col("text").cast("binary")).alias("packed"))
    cut = F.substring("packed", F.lit(1), F.length("packed") - 5)
    return packed.select("doc_id", F.when(F.col("doc_id") % 10 == 7, cut).otherwise(F.col("packed")).alias("payload"))


FEEDS = {
    "authn_messages": authn_messages,
    "authz_documents": authz_documents,
    "raw_messages": raw_messages,
    "authz_table": authz_table,
    "base64_texts": base64_texts,
    "brotli_texts": brotli_texts,
}
TEXT_FEEDS = ("base64_texts", "brotli_texts")
_stored: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder holding a feed as Parquet, the way a queue dump would arrive; written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_dir(spark, name) + "/messages"
        tasks = spark.sparkContext.defaultParallelism
        # a queue dump comes in many files
        if name in TEXT_FEEDS:
            rows = FEEDS[name](spark, sf_dir).repartition(tasks)
        else:
            rows = FEEDS[name](spark, sf_dir, tasks)
        rows.write.parquet(path)
        _stored[key] = path
    return _stored[key]


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(stored_path(spark, sf_dir, name))
