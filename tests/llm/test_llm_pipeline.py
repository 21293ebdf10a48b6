import corpus_pipeline
import pytest

from gatewire.llm import decontaminate, near_dedup, quality, queries, secrets

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF_DIR).cache()
        out.append((docs, result))
        docs = result
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    labels, items = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("labels", "benchmark"))
    before, after = stages[0]
    assert ids(after) == ids(quality.scores(before, labels).filter("predicted = 1"))
    before, after = stages[1]
    assert ids(after) == ids(near_dedup.near_duplicates(before).filter("doc_id = class_id"))
    before, after = stages[2]
    leaking = {r["doc_id"] for r in decontaminate.leaks(before, items).collect()}
    assert leaking and ids(after) == [i for i in ids(before) if i not in leaking]
    before, after = stages[3]
    assert ids(after) == ids(before)
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == secrets.mask(text[r["doc_id"]], secrets.all_spans(text[r["doc_id"]])[1])
        assert r["n_chars"] == len(r["text"])
    before, after = stages[4]
    assert ids(after) == ids(before)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][1].select("doc_id", "ids_sha256").collect()))


def test_odd_rows_pass_through_all_stages(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= start.count()


def test_every_operator_is_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
