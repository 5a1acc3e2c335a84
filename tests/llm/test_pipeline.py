import pytest

import corpus_pipeline
from cinelake.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_all_but_the_last_stage_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert all(s.count() > 0 for s in stages)


def test_decisions_take_effect(spark, stages):
    toxic, unique, redacted = stages[:3]
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.6 * n < toxic.count() <= n and unique.count() < toxic.count() and redacted.count() == unique.count()
    assert unique.groupBy("text").count().filter("count > 1").count() == 0
    assert redacted.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0


def test_sequences_are_gapless(stages):
    packed = stages[-1].toPandas()  # a few hundred rows
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]) and rows["length"].sum() <= 4096


def test_run_gives_the_same_rows(spark, stages):
    ours, run = (sorted(map(repr, df.select("length", "ids_crc32").collect())) for df in (stages[-1], corpus_pipeline.run(spark, SMALL)))
    assert ours == run


def test_queries_have_one_entry_per_operator():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
