"""Sample messages used by several tests."""

import base64
import json

import pyarrow as pa

AUTHN = {
    "Created": "2023-09-12T17:03:29.408153Z",
    "UserId": 31415926,
    "EventType": "Authenticate",
    "AuthenticationMethod": "BankId",
    "AuthenticationLevel": "VerySensitive",
}

STRING_TYPE = "http://www.w3.org/2001/XMLSchema#string"


def attribute(name, *values):
    return {
        "Issuer": None,
        "AttributeId": name,
        "IncludeInResult": False,
        "AttributeValues": [{"Value": x, "DataType": STRING_TYPE, "Attributes": [], "Elements": []} for x in values],
    }


def category(name, *attributes):
    return {"Id": None, "Content": None, "Category": name, "Attributes": list(attributes)}


CONTEXT = {
    "ReturnPolicyIdList": False,
    "CombinedDecision": False,
    "XPathVersion": None,
    "Attributes": [
        category("access-subject", attribute("org", "unit9"), attribute("role", "clerk", "head")),
        category("action", attribute("action-id", "read")),
        category("environment"),
    ],
    "RequestReferences": [],
}

AUTHZ = {
    "SubjectUserId": 4711008,
    "Created": "2018-05-23T19:41:07+00:00",
    "ResourcePartyId": 6080,
    "Resource": "permit-form",
    "InstanceId": "6080/0d5e9a7c-41b8-4f63-8e21-9b7c5f0a3d64",
    "Operation": "read",
    "IpAdress": "192.0.2.1",
    "ContextRequestJson": CONTEXT,
    "Decision": "Permit",
    "SubjectPartyUuid": "5ac81e02-97d4-4b36-a0f5-c2e8614b7d90",
}


def text(document, **changes):
    """JSON of a document with fields replaced, or removed where the value is ``...``."""
    merged = {**document, **changes}
    return json.dumps({key: value for key, value in merged.items() if value is not ...})


def brotli(data):
    return pa.Codec("brotli").compress(data, asbytes=True)


def v01(document):
    return b"01" + brotli(document)


def b64(data):
    return base64.b64encode(data)


def checked_events(spark, events, open_months):
    """What checking authentication messages gives, made by hand as that is quick: (sessionid, instant) and months as text."""
    from gatewire.schemas import AUTHN_COLUMNS

    rows = [
        (i, text(AUTHN, SessionId=name, Created=f"{at}Z"), name, at, at[:7] in open_months)
        for i, (name, at) in enumerate(events)
    ]
    made = spark.createDataFrame(rows, "msg_id long, body string, sessionid string, at string, is_valid boolean").coalesce(1)
    given = {"sessionid": "sessionid", "created": "CAST(at AS TIMESTAMP)", "isauthenticated": "FALSE"}
    columns = [f"{given.get(c, f'CAST(NULL AS {t})')} AS {c}" for c, t in AUTHN_COLUMNS.items()]
    errors = "CASE WHEN is_valid THEN map() ELSE map('no_partition', 'Created') END AS errors"
    return made.selectExpr("msg_id", "body", errors, "is_valid", *columns)
