"""Tables whose layout has changed, read as one by the ids of their columns.

A column keeps its id whatever it is called and however wide its type becomes.  Files are
written with the ids of their layout, and Parquet columns are found by them, so files of
several generations may lie in one folder and are read in one scan: renamed columns
appear under their newest name, wider types take in narrower ones, and columns that a
file doesn't have are NULL.  An id is never used again, so a new column that takes the name of
one that was dropped doesn't show what the old one held.  Files from before there were ids are read by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from gatewire.functions.months import month_start

FIELD_ID = "parquet.field.id"
READ_BY_ID = "spark.sql.parquet.fieldId.read.enabled"


@dataclass(frozen=True)
class Layout:
    """One generation of a table: its columns as id -> (name, type)."""

    columns: dict[int, tuple[str, str]]

    def schema(self) -> StructType:
        plain = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in self.columns.values()))
        return StructType([StructField(f.name, f.dataType, True, {FIELD_ID: i}) for i, f in zip(self.columns, plain.fields)])

    def renamed(self, **names: str) -> Layout:
        """The next generation, with other names (``old="new"``)."""
        self._must_have(names)
        return Layout({i: (names.get(name, name), kind) for i, (name, kind) in self.columns.items()})

    def widened(self, **kinds: str) -> Layout:
        """The next generation, with wider types."""
        self._must_have(kinds)
        return Layout({i: (name, kinds.get(name, kind)) for i, (name, kind) in self.columns.items()})

    def without(self, *names: str) -> Layout:
        self._must_have(names)
        return Layout({i: column for i, column in self.columns.items() if column[0] not in names})

    def _must_have(self, names) -> None:
        unknown = set(names) - {name for name, _ in self.columns.values()}
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")


class Registry:
    """All layouts that a table has had, oldest first; hands out ids that were never used."""

    def __init__(self, first: dict[str, str]):
        self.layouts = [Layout(dict(enumerate(first.items(), 1)))]
        self._next = len(first) + 1

    @property
    def newest(self) -> Layout:
        return self.layouts[-1]

    def add(self, layout: Layout) -> Layout:
        names = [name.lower() for name, _ in layout.columns.values()]
        if len(set(names)) < len(names):
            raise ValueError("two columns of one name")
        if unknown := set(layout.columns) - set(self.newest.columns):
            raise ValueError(f"ids {sorted(unknown)} are not from the layout before")
        self.layouts.append(layout)
        return layout

    def with_column(self, name: str, kind: str) -> Layout:
        """The next generation, with one more column."""
        layout = Layout(self.newest.columns | {self._next: (name, kind)})
        if name.lower() in [known.lower() for known, _ in self.newest.columns.values()]:
            raise ValueError(f"there is a column {name}")
        self._next += 1
        self.layouts.append(layout)
        return layout


def append_generation(events: DataFrame, path: str, layout: Layout, created: str = "created") -> None:
    """Append events in a layout to a table by month."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in layout.schema().fields]
    rows = events.select(*columns, month_start(F.col(created)).alias("created_month"))
    rows.write.mode("append").partitionBy("created_month").parquet(path)


def read_generation(spark: SparkSession, path: str, layout: Layout, by_name: Layout | None = None) -> DataFrame:
    """A table with files of any generation that has ids, in one layout.

    ``by_name`` is the layout of files without ids, which must then lie in a folder of their
    own: they are read by its names and shown as the other layout calls the same ids.
    """
    if by_name is not None:
        plain = StructType([StructField(f.name, f.dataType) for f in by_name.schema().fields])
        rows = spark.read.schema(plain.add("created_month", "date")).parquet(path)
        return rows.select(
            *[
                (F.col(by_name.columns[i][0]) if i in by_name.columns else F.lit(None)).cast(kind).alias(name)
                for i, (name, kind) in layout.columns.items()
            ],
            "created_month",
        )
    if spark.conf.get(READ_BY_ID) != "true":
        raise ValueError(f"reading by column ids needs {READ_BY_ID} (see configure)")
    return spark.read.schema(layout.schema().add("created_month", "date")).parquet(path)
