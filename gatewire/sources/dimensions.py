"""The four lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewire import vocabulary as v
from gatewire.schemas import DIMENSION_DDL

DIMENSIONS = ("authenticationeventtype", "authenticationmethod", "authenticationlevel", "decision")


def literal_dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows given in code. As VALUES and not as a Python collection, because then Catalyst knows the size."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join(f"({id_}, {quoted(name)}, {quoted(text)})" for id_, name, text in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, name, description)")


SEED_ROWS = {
    "authenticationeventtype": v.EVENT_TYPE_ROWS,
    "authenticationmethod": v.AUTHENTICATION_METHOD_ROWS,
    "authenticationlevel": v.SECURITY_LEVEL_ROWS,
    "decision": v.DECISION_ROWS,
}


def seed_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The lookup tables as first set up; ``insert_if_absent`` brings stored ones up to date."""
    return {name: literal_dimension(spark, rows) for name, rows in SEED_ROWS.items()}


def current_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The lookup tables with the rows that were added later."""
    rows = SEED_ROWS | {"authenticationmethod": v.AUTHENTICATION_METHOD_ROWS + v.AUTHENTICATION_METHOD_LATER_ROWS}
    return {name: literal_dimension(spark, part) for name, part in rows.items()}


def save_dimensions(dimensions: dict[str, DataFrame], root: str) -> None:
    for name, rows in dimensions.items():
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{name}")


def load_dimensions(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(DIMENSION_DDL).parquet(f"{root}/{name}") for name in DIMENSIONS}
