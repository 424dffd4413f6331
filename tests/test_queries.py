import datetime
import re
from pathlib import Path

import duckdb
import pytest

from meterlake.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    answer = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


def test_entry_and_optional_corpus_part(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # nothing outside names the optional part but the entry module
    root = Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_the_log_and_the_outbox_are_one_pass(spark):
    """All windows lie in two exchanges of the events, by subscriber and by family; alerts and details move nothing more."""
    d = catalog.Domain(spark, SMALL)
    plan = lambda name: catalog.QUERIES[name](d)._jdf.queryExecution().executedPlan().toString()
    moves = {name: plan(name).count("Exchange hashpartitioning") for name in ("allocate_waterfall", "applied_log", "outbox_rows")}
    assert len(set(moves.values())) == 1 and plan("outbox_rows").count("Window [") <= plan("allocate_waterfall").count("Window [") + 2, moves


def test_timestamp_types(spark):
    df = catalog.QUERIES["dedup_events"](catalog.Domain(spark, SMALL))
    assert dict(df.dtypes)["kst"] == "timestamp_ntz"
    assert isinstance(df.first().kst, datetime.datetime)
