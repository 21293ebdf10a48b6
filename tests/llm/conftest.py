import pytest
from llm_fixtures import prose

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, score string, bucket int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, a repeated row, names that clash with inner columns."""
    base = prose(1, 300)
    texts = {
        0: base,
        1: base + " one more",
        2: None,
        3: "",
        4: "   \n\t ",
        5: "!!! ... ???",
        6: "one two",
        7: "One, TWO!",
        8: prose(2, 40_000, 9000),
        9: prose(3, 250) + " password = abc.DEF/123 " + "z" * 3000,
        10: "Ünïcödé ẞtraße Ελληνικά 日本語 🙂 " * 5,
        11: base.upper(),
        12: base,
        -5: prose(4, 120),
    }
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src0", None, "x", "y", i) for i, t in texts.items()]
    rows += [rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
