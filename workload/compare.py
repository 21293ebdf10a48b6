"""Run queries and their expected SQL side by side; used by the tests and from the command line."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


SPARK_TO_SQL = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(spark: SparkSession, con, sf_dir: str, build, sql: str) -> str | None:
    """What is different between a query and its expected result, None if nothing is."""
    result = build(spark, sf_dir)
    order = sorted(result.columns)
    got = Counter(tuple(_value(row[c]) for c in order) for row in result.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != order:
        return f"columns {order} instead of {sorted(names)}"
    at = [names.index(c) for c in order]
    want = Counter(tuple(_value(row[i]) for i in at) for row in cursor.fetchall())
    types = {c: (SPARK_TO_SQL.get(t, t), kinds[c]) for c, t in result.dtypes}
    wrong = {c: pair for c, pair in types.items() if pair[0] != pair[1] and pair[1] != '"NULL"'}
    if got != want:
        extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows, expected {sum(want.values())}; extra {extra}; lacking {lacking}"
    if not got:
        return "no rows"
    return f"types (got, expected) {wrong}" if wrong else None


def main(sf_dir: str, names: list[str]) -> None:
    import gatewire
    from workload.queries import ORACLES, QUERIES

    spark = gatewire.build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            found = difference(spark, con, sf_dir, QUERIES[name], ORACLES[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - begin:.1f}s {(found or '')[:1500]}", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
