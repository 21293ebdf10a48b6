"""Envelope decision table."""

import pytest
from pyspark.sql import functions as F

from gatewire.functions.brotli import inflate
from gatewire.functions.envelope import strict_base64
from gatewire.functions.problems import errors_map
from gatewire.operators.envelope import decode

from samples import AUTHZ, b64, brotli, text, v01

DOCUMENT = text(AUTHZ).encode()

CASES = {
    "plain": (DOCUMENT, DOCUMENT, None),
    "base64": (b64(DOCUMENT), DOCUMENT, None),
    "base64 in lines": (b64(DOCUMENT)[:40] + b"\r\n" + b64(DOCUMENT)[40:] + b"\n", DOCUMENT, None),
    "compressed": (v01(DOCUMENT), DOCUMENT, None),
    "base64 of compressed": (b64(v01(DOCUMENT)), DOCUMENT, None),
    # base64 of a byte order mark happens to begin with two digits
    "base64 with byte order mark": (b64(b"\xef\xbb\xbf" + DOCUMENT), None, "unsupported_version"),
    "compressed with byte order mark": (v01(b"\xef\xbb\xbf" + DOCUMENT), DOCUMENT, None),
    "base64 of other text": (b64(b"hello!"), b"hello!", None),
    "unknown version": (b"99abc", None, "unsupported_version"),
    "version zero": (b"00" + DOCUMENT, None, "unsupported_version"),
    "base64 of unknown version": (b64(b"02" + DOCUMENT), None, "unsupported_version"),
    "blank in front": (b" " + DOCUMENT, None, "bad_base64"),
    "byte order mark in front": (b"\xef\xbb\xbf" + DOCUMENT, None, "bad_base64"),
    "no padding": (b64(b"hello!!").rstrip(b"="), None, "bad_base64"),
    "one digit": (b"1{}", None, "bad_base64"),
    "sign and digit": (b"+1{}", None, "bad_base64"),
    "bytes that are no text": (b"\xff\xfe\xfd\xfc", None, "bad_base64"),
    "base64 of one byte": (b64(b"x"), None, "too_short_decoded"),
    "blanks only": (b"    ", None, "too_short_decoded"),
    "compressed, cut short": (v01(DOCUMENT)[:-5], None, "bad_brotli"),
    "compressed, garbage": (b"01garbage", None, "bad_brotli"),
    "version without payload": (b"01", None, "bad_brotli"),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(i, body) for i, (body, _, _) in enumerate(CASES.values())]
    messages = spark.createDataFrame(rows, "msg_id long, body binary")
    result = decode(messages).select("msg_id", "json", F.map_keys(errors_map(F.col("problems"))).alias("codes"))
    return {row.msg_id: row for row in result.collect()}


@pytest.mark.parametrize("number, case", list(enumerate(CASES)), ids=list(CASES))
def test_case(decoded, number, case):
    _, document, code = CASES[case]
    row = decoded[number]
    assert row.codes == ([code] if code else [])
    assert row.json == (document.decode() if document else None)


@pytest.mark.parametrize("body", [b"", b"{", b"1"])
def test_short_messages_vanish(spark, body):
    assert decode(spark.createDataFrame([(1, body)], "msg_id long, body binary")).collect() == []


def test_one_bad_payload_does_not_touch_others(spark):
    whole = v01(DOCUMENT)
    bodies = [whole if i % 3 else whole[: -1 - i % 50] for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "msg_id long, body binary").repartition(4)
    good = decode(frame).where("json IS NOT NULL")
    assert good.count() == sum(1 for i in range(3000) if i % 3)
    assert good.select("json").distinct().collect()[0].json == DOCUMENT.decode()


@pytest.mark.parametrize(
    "encoded, content",
    [
        (b"QUJD", b"ABC"),
        (b"QQ==", b"A"),
        (b"QQ==\n", b"A"),
        (b"Q Q = =", b"A"),
        (b"QQ=", None),
        (b"QQ", None),
        (b"QUJD*===", None),
        (b"=QQ=", None),
        (b"QQ==QQ==", None),
        (b"QUJ-", None),
    ],
)
def test_strict_base64(spark, encoded, content):
    row = spark.createDataFrame([(encoded,)], "body binary").select(strict_base64(F.col("body")).alias("x")).first()
    assert (bytes(row.x) if row.x is not None else None) == content


def test_large_payload_survives_whole(spark):
    big = (b'{"x":"' + b"abcdefghij" * 300_000 + b'"}')
    row = decode(spark.createDataFrame([(1, b"01" + brotli(big))], "msg_id long, body binary")).first()
    assert row.json == big.decode()


def test_payloads_that_inflate_a_lot(spark):
    """Some 2.5 GB of documents from kilobytes, in one partition: they come back in parts of bounded size."""
    body = v01(b'{"a":"' + b"x" * 300_000 + b'"}')
    messages = spark.range(0, 9000, 1, 1).select(F.col("id").alias("msg_id"), F.lit(body).alias("body"))
    row = decode(messages).agg(F.count("*").alias("n"), F.min(F.length("json")).alias("least"), F.max("problems").alias("p")).first()
    assert (row.n, row.least, row.p) == (9000, 300_008, "")


def test_a_message_goes_through_python_once(spark):
    """Not again as what it holds, unless that was base64 or is to be inflated."""
    plan = decode(spark.createDataFrame([], "msg_id long, body binary"))._jdf.queryExecution().optimizedPlan().toString()
    [line] = [line for line in plan.splitlines() if "MapInArrow" in line]
    given = line.split("run(", 1)[1].split(")", 1)[0]
    assert [name.split("#")[0].strip() for name in given.split(",")] == ["msg_id", "body", "problems", "_packed", "_bare", "_content"]


def test_inflated_and_other_rows_stay_in_order_in_small_parts(spark):
    rows = [(i, [None, b"plain", brotli(b"x" * i), b"no brotli"][i % 4], i % 4 >= 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, content binary, packed boolean").coalesce(1)
    found = [(row.i, row.content and bytes(row.content)) for row in inflate(frame, "content", "packed", most_bytes=100).collect()]
    assert found == [(i, [None, b"plain", b"x" * i, None][i % 4]) for i in range(200)]
