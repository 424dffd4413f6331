import numpy as np
from pyspark.sql import functions as F

from meterlake.functions.draws import split, splits, uniform, uniforms
from meterlake.plans import seed
from meterlake.plans.catalog import Domain
from meterlake.sources import fixtures, generator
from meterlake.streaming import metrics

SMALL = "/root/testdata/sf0.001"


def test_seed_replaces_what_was_there(spark, tmp_path):
    d = Domain(spark, SMALL)
    source = {
        "subscription": d.subscription, "plan": fixtures.plan(spark), "family": fixtures.family(spark, SMALL), "family_sub": d.family_sub, "present_data": d.presents, "app_blocked_service": d.services,
        "blocked_service_sub": fixtures.blocked_service_sub(spark, SMALL), "policy_sub": d.policy_sub, "block_policy": d.policies,
    }
    for _ in range(2):
        names = seed.load(source, str(tmp_path))
    assert len(names) == 10
    assert spark.read.parquet(str(tmp_path / "plan_limit")).count() == d.plans.count()


def test_split_keeps_the_total(spark):
    rows = spark.createDataFrame([(t, w, m) for t in (0, 1, 5, 1000, 99_999) for w in ([1.0], [1.0, 2.0, 3.0], [0.9] * 31) for m in (0, 1)], "total bigint, w array<double>, m int")
    for least in (0, 1):
        got = rows.where(F.col("m") == least).select("total", "w", split(F.col("total"), F.col("w"), least).alias("s")).collect()
        assert all(sum(r.s) == r.total and len(r.s) == len(r.w) and min(r.s) >= (least if r.total >= len(r.w) * least else 0) for r in got)


def test_plan_check_and_live_source(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    bad = spark.createDataFrame([(1, 2, -1)], "sub_id bigint, plan_id bigint, plan_limit bigint")
    with pytest.raises(PySparkException):
        generator.checked_plans(bad).collect()
    seen = metrics.Progress()
    spark.streams.addListener(seen)
    stream = metrics.counted(generator.stream(spark, 50, 10).withColumn("status", F.lit("ok")))
    q = stream.writeStream.format("memory").queryName("generated").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("select * from generated").count():
                break
            __import__("time").sleep(0.5)
        rows = spark.sql("select * from generated").collect()
        assert rows and all(1 <= r.app_id <= 19 and 50 <= r.bytes <= 500 for r in rows)
    finally:
        q.stop()
        spark.streams.removeListener(seen)
    assert "usage_rows_total" in seen.exposition()


def test_history_over_more_than_a_thousand_apps(spark):
    from meterlake.sources import generator

    days = spark.sql("select 1L as sub_id, '20240101' as day, '202401' as yyyymm, 10000000L as used")
    apps = spark.range(100_001, 101_201).withColumnRenamed("id", "app_id")
    rows = generator.history_apps(days, apps).collect()
    assert len({r.app_id for r in rows}) == 1200 and sum(r.used for r in rows) == 10_000_000


def _plans(spark, subs):
    plan = F.element_at(F.array(*[F.lit(x) for x in (-1, 10_000_000, 20_000_000, 40_000_000, 1_048_576)]), (F.col("sub_id") % 5 + 1).cast("int"))
    return spark.range(1, subs + 1).select((F.col("id") * 3).alias("sub_id")).distinct().select("sub_id", (F.col("sub_id") % 5 + 1).alias("plan_id"), plan.cast("bigint").alias("plan_limit"))


def test_a_history_is_dealt_over_all_tasks(spark):
    """Few subscribers become many rows: adaptive execution would leave them to one task, as it looks at their bytes."""
    days = generator.history_days(_plans(spark, 500), "2024-01-17")
    sizes = [r["count"] for r in days.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < sum(sizes) / 6
    assert sum(sizes) == 500 * 169  # each plan has each day from August 1 to January 16
    # days move nowhere once they are made: nothing but the plans is grouped
    assert "collect_list" not in days._jdf.queryExecution().optimizedPlan().toString()


def test_arrays_are_drawn_and_split_as_columns_are(spark):
    labels, items = ["a|1", "b|2024-01-01", "é|3"], ["1", "02", "x"]
    rows = spark.createDataFrame([(x, i) for x in labels for i in items], "x string, i string")
    assert uniforms(labels, items).ravel().tolist() == [r[0] for r in rows.select(uniform(F.col("x"), F.col("i"))).collect()]
    cases = [(t, [0.3 + (i * 7 + t) % 5 for i in range(n)]) for n in (1, 2, 8, 18) for t in (0, 1, 7, 8, 19, 1001, 123_457, 2**40 + 1)]
    for least in (0, 1):
        want = spark.createDataFrame(cases, "t bigint, w array<double>").select(split(F.col("t"), F.col("w"), least)).collect()
        assert [splits(np.array([t]), np.array([w]), least)[0].tolist() for t, w in cases] == [r[0] for r in want]


def test_history_without_apps_and_of_less_than_a_part_each(spark):
    days = spark.sql("select id as sub_id, date'2024-01-01' as day, '202401' as yyyymm, id as used from range(40)")
    apps = spark.range(1, 31).withColumnRenamed("id", "app_id")
    assert generator.history_apps(days, apps.limit(0)).count() == 0
    for rows, parts in ((generator.history_apps(days, apps), 29), (generator.history_slots(days), 8)):
        got = rows.groupBy("sub_id").agg(F.sum("used").alias("used"), F.count("*").alias("n"), F.min("used").alias("least")).collect()
        assert len(got) == 40 and all(r.used == r.sub_id and r.n == parts and r.least >= (r.sub_id >= parts) for r in got)
