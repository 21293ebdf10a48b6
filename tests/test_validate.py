"""Every rule alone, and several at once."""

import datetime as dt

import pytest

import gatewire
from gatewire.operators import partitions
from gatewire.plans.ingest import check_authn, check_authz, check_authz_documents, rejected
from gatewire.schemas import AUTHN_COLUMNS, AUTHZ_COLUMNS

from samples import AUTHN, AUTHZ, b64, text, v01

AUTHN_CASES = {
    "good": (text(AUTHN), {}),
    "null document": ("null", {"not_object": "body"}),
    "no date": (text(AUTHN, Created=...), {"created_missing": "Created"}),
    "null date": (text(AUTHN, Created=None), {"created_missing": "Created"}),
    "bad date": (text(AUTHN, Created="x"), {"bad_created": "Created"}),
    "bad number": (text(AUTHN, UserId="1"), {"bad_int": "UserId"}),
    "bad name": (text(AUTHN, AuthenticationMethod="x"), {"bad_enum": "AuthenticationMethod"}),
    "bad text": (text(AUTHN, SessionId=1), {"bad_string": "SessionId"}),
    "bad boolean": (text(AUTHN, IsAuthenticated="true"), {"bad_bool": "IsAuthenticated"}),
    "no event type": (text(AUTHN, EventType=...), {"fk_eventtype": "eventtypeid"}),
    "unknown event type": (text(AUTHN, EventType=5), {"fk_eventtype": "eventtypeid"}),
    "unknown method": (text(AUTHN, AuthenticationMethod=23), {"fk_method": "authenticationmethodid"}),
    "later method": (text(AUTHN, AuthenticationMethod=22), {}),
    "no method": (text(AUTHN, AuthenticationMethod=None), {}),
    "unknown level": (text(AUTHN, AuthenticationLevel=-1), {"fk_level": "authenticationlevelid"}),
    "month before": (text(AUTHN, Created="2023-07-31T23:59:59.999999Z"), {"no_partition": "Created"}),
    "first instant": (text(AUTHN, Created="2023-08-01T00:00:00Z"), {}),
    "last instant": (text(AUTHN, Created="2023-10-31T23:59:59.9999999Z"), {}),
    "month after": (text(AUTHN, Created="2023-11-01T00:00:00Z"), {"no_partition": "Created"}),
    "offset decides month": (text(AUTHN, Created="2023-10-31T23:30:00-01:00"), {"no_partition": "Created"}),
    "several": (
        text(AUTHN, Created=..., EventType=9, UserId=1.5, OrgNumber=True),
        {"created_missing": "Created", "fk_eventtype": "eventtypeid", "bad_int": "UserId OrgNumber"},
    ),
}

AUTHZ_CASES = {
    "good": (text(AUTHZ), {}),
    "null document": ("null", {"not_object": "json"}),
    "no date": (text(AUTHZ, Created=...), {"created_missing": "Created"}),
    "no operation": (text(AUTHZ, Operation=...), {"operation_missing": "Operation"}),
    "empty operation": (text(AUTHZ, Operation=""), {"operation_missing": "Operation"}),
    "null operation": (text(AUTHZ, Operation=None), {"operation_missing": "Operation"}),
    "bad operation": (text(AUTHZ, Operation=5), {"bad_string": "Operation"}),
    "blank operation": (text(AUTHZ, Operation=" "), {}),
    "no context": (text(AUTHZ, ContextRequestJson=...), {"context_not_object": "ContextRequestJson"}),
    "null context": (text(AUTHZ, ContextRequestJson=None), {"context_not_object": "ContextRequestJson"}),
    "list as context": (text(AUTHZ, ContextRequestJson=[]), {"context_not_object": "ContextRequestJson"}),
    "text as context": (text(AUTHZ, ContextRequestJson="x"), {"context_not_object": "ContextRequestJson"}),
    "empty context": (text(AUTHZ, ContextRequestJson={}), {}),
    "empty context as text": (text(AUTHZ, ContextRequestJson="{}"), {}),
    "no decision": (text(AUTHZ, Decision=...), {"decision_missing": "Decision"}),
    "null decision": (text(AUTHZ, Decision=None), {"decision_missing": "Decision"}),
    "bad decision": (text(AUTHZ, Decision="x"), {"bad_enum": "Decision"}),
    "decision too large": (text(AUTHZ, Decision=4), {"decision_range": "Decision"}),
    "decision negative": (text(AUTHZ, Decision=-1), {"decision_range": "Decision"}),
    "largest decision": (text(AUTHZ, Decision=2147483647), {"decision_range": "Decision"}),
    "last decision": (text(AUTHZ, Decision="notapplicable"), {}),
    "bad number": (text(AUTHZ, SubjectParty="x"), {"bad_int": "SubjectParty"}),
    "long uuid": (text(AUTHZ, SubjectPartyUuid="æ" * 256), {"uuid_too_long": "SubjectPartyUuid"}),
    "longest uuid": (text(AUTHZ, SubjectPartyUuid="æ" * 255), {}),
    "closed month": (text(AUTHZ, Created="2018-08-01T00:00:00Z"), {"no_partition": "Created"}),
}


def catalog(spark, day):
    return partitions.plan_partitions(partitions.on_day(spark, day))


@pytest.fixture(scope="module")
def authn_results(spark, dimensions):
    rows = [(i, body) for i, (body, _) in enumerate(AUTHN_CASES.values())]
    messages = spark.createDataFrame(rows, "msg_id long, body string")
    checked = check_authn(messages, dimensions, catalog(spark, dt.date(2023, 9, 7)))
    return {row.msg_id: row for row in checked.collect()}


@pytest.fixture(scope="module")
def authz_results(spark, dimensions):
    rows = [(i, body.encode()) for i, (body, _) in enumerate(AUTHZ_CASES.values())]
    messages = spark.createDataFrame(rows, "msg_id long, body binary")
    checked = check_authz_documents(messages, dimensions, catalog(spark, dt.date(2018, 6, 1)))
    return {row.msg_id: row for row in checked.drop("contextrequestjson").collect()}


@pytest.mark.parametrize("number", range(len(AUTHN_CASES)), ids=list(AUTHN_CASES))
def test_authn(authn_results, number):
    row = authn_results[number]
    expected = list(AUTHN_CASES.values())[number][1]
    assert row.errors == expected
    assert row.is_valid == (not expected)


@pytest.mark.parametrize("number", range(len(AUTHZ_CASES)), ids=list(AUTHZ_CASES))
def test_authz(authz_results, number):
    row = authz_results[number]
    expected = list(AUTHZ_CASES.values())[number][1]
    assert row.errors == expected
    assert row.is_valid == (not expected)


def test_enveloped_events_come_out_equal(spark, dimensions):
    document = text(AUTHZ).encode()
    bodies = [document, b64(document), v01(document), b64(v01(document)), b"99abc", b"x"]
    messages = spark.createDataFrame(list(enumerate(bodies)), "msg_id long, body binary")
    checked = check_authz(messages, dimensions, catalog(spark, dt.date(2018, 6, 1))).cache()
    stored = gatewire.accepted(checked, "authz")
    assert stored.columns == list(AUTHZ_COLUMNS)
    assert [t for _, t in stored.dtypes] == list(AUTHZ_COLUMNS.values())
    rows = [str(row) for row in stored.collect()]
    assert len(rows) == 4 and len(set(rows)) == 1
    assert [(r.msg_id, bytes(r.body), r.errors) for r in rejected(checked).collect()] == [
        (4, b"99abc", {"unsupported_version": "body"})
    ]


def test_missing_lookup_row_is_reported(spark, dimensions):
    fewer = dimensions | {"decision": dimensions["decision"].where("id <> 1")}
    messages = spark.createDataFrame([(1, text(AUTHZ).encode())], "msg_id long, body binary")
    row = check_authz(messages, fewer, catalog(spark, dt.date(2018, 6, 1))).first()
    assert row.errors == {"fk_decision": "decision"}


def test_table_columns(spark, dimensions):
    messages = spark.createDataFrame([(1, text(AUTHN))], "msg_id long, body string")
    checked = check_authn(messages, dimensions, catalog(spark, dt.date(2023, 9, 7)))
    stored = gatewire.accepted(checked, "authn")
    assert dict(stored.dtypes) == AUTHN_COLUMNS and stored.columns == list(AUTHN_COLUMNS)
    good, bad = gatewire.split(checked)
    assert (good.count(), bad.count()) == (1, 0)


def test_ingest_plan_has_no_shuffle(spark, dimensions, tmp_path):
    """One scan of the messages, broadcast lookups, nothing exchanged by key."""
    spark.createDataFrame([(1, text(AUTHZ).encode())], "msg_id long, body binary").write.parquet(f"{tmp_path}/m")
    open_months = catalog(spark, dt.date(2018, 6, 1))
    gatewire.save_catalog(open_months, f"{tmp_path}/c")
    checked = check_authz(
        gatewire.read_messages(spark, f"{tmp_path}/m", "authz"),
        dimensions,
        gatewire.load_catalog(spark, f"{tmp_path}/c"),
    )
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/m") == 1
    assert plan.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    # the two lookups are made distinct; nothing else is exchanged
    assert plan.count("hashpartitioning") == 2
    assert plan.count("MapInArrow") == 1
