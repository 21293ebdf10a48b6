"""Column layouts of messages, event tables and lookup tables."""

from pyspark.sql import types as T

AUTHN_COLUMNS = {
    "sessionid": "string",
    "externalsessionid": "string",
    "subscriptionkey": "string",
    "externaltokenissuer": "string",
    "created": "timestamp",
    "userid": "int",
    "supplierid": "string",
    "orgnumber": "int",
    "eventtypeid": "int",
    "authenticationmethodid": "int",
    "authenticationlevelid": "int",
    "ipaddress": "string",
    "isauthenticated": "boolean",
}

AUTHZ_COLUMNS = {
    "sessionid": "string",
    "created": "timestamp",
    "subjectuserid": "int",
    "subjectorgcode": "string",
    "subjectorgnumber": "int",
    "subjectparty": "int",
    "resourcepartyid": "int",
    "resource": "string",
    "instanceid": "string",
    "operation": "string",
    "ipaddress": "string",
    "contextrequestjson": "variant",
    "decision": "int",
    "subject_party_uuid": "string",
}

FACT_COLUMNS = {"authn": AUTHN_COLUMNS, "authz": AUTHZ_COLUMNS}

# The first generation of the tables: no subject_party_uuid, cut by calendar year.
FACT_COLUMNS_V0 = {
    "authn": AUTHN_COLUMNS,
    "authz": {c: t for c, t in AUTHZ_COLUMNS.items() if c != "subject_party_uuid"},
}

DIMENSION_DDL = "id INT, name STRING, description STRING"
CATALOG_DDL = "schema_name STRING, name STRING, start_date DATE, end_date DATE"
MESSAGE_DDL = {"authn": "msg_id BIGINT, body STRING", "authz": "msg_id BIGINT, body BINARY"}
# With the number of tries that a refused message has had, and when it first came.
QUARANTINE_DDL = "msg_id BIGINT, body BINARY, errors MAP<STRING, STRING>, attempts INT, arrived TIMESTAMP"

CONTEXT_REQUEST_DDL = """
    struct<
      ReturnPolicyIdList: boolean,
      CombinedDecision: boolean,
      XPathVersion: string,
      Attributes: array<struct<
        Category: string,
        Id: string,
        Content: string,
        Attributes: array<struct<
          AttributeId: string,
          Issuer: string,
          IncludeInResult: boolean,
          AttributeValues: array<struct<Value: string, DataType: string>>>>>>>
"""

# Beside the request: what flattening reads of it, and a mark that is missing in older files.
SHREDDED_ATTRIBUTES, SHREDDED_MARK = "contextattributes", "contextshredded"
SHREDDED_COLUMNS = {
    "authn": {},
    "authz": {
        SHREDDED_ATTRIBUTES: """array<struct<
            Category: string,
            Attributes: array<struct<
                AttributeId: string,
                Issuer: string,
                IncludeInResult: boolean,
                AttributeValues: array<struct<Value: string, DataType: string>>>>>>""",
        SHREDDED_MARK: "boolean",
    },
}


def stored_schema(kind: str) -> T.StructType:
    """Columns of the files of an event table that messages are ingested into."""
    return _struct(FACT_COLUMNS[kind] | SHREDDED_COLUMNS[kind])


def fact_schema(kind: str) -> T.StructType:
    """Newest layout of an event table; reading old files with it yields NULLs for newer columns."""
    return _struct(FACT_COLUMNS[kind])


def first_schema(kind: str) -> T.StructType:
    """Layout of the first generation of an event table."""
    return _struct(FACT_COLUMNS_V0[kind])


def _struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
