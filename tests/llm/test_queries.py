import re

import duckdb
import pytest

import corpus_pipeline
from meterlake.llm import entry
from meterlake.llm.common import table, written

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.sql(f"create view {name_} as select * from '{SMALL}/{name_}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    answer = con.sql(entry.oracle_sql()[name])
    at = [answer.columns.index(c) for c in columns]
    assert sorted(answer.columns) == columns
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in answer.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14))


def test_held_out_language_and_quality(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "lang").toPandas()
    got = entry.queries()["op4_langid"](spark, SMALL).toPandas().merge(docs, on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95
    labels = table(spark, SMALL, "labels").toPandas()
    got = entry.queries()["op3_pu_quality"](spark, SMALL).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]
    got = got.merge(labels, on="doc_id")
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.9


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        after = docs.count()
        assert 0 < after <= before, name
        if name != "pieces":
            assert docs.columns == columns, name
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == after
        before = after
    assert docs.where("not round_trip").count() == 0


def test_pipeline_stages_on_odd_rows(spark, sample):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, sample, SMALL)
        assert out.count() <= sample.count(), name
        if name != "pieces":
            assert out.columns == sample.columns, name
        assert stage(spark, sample.limit(0), SMALL).count() == 0, name
