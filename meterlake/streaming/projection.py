"""Monthly totals kept from the applied log by adding what is new, equal to a rebuild from the whole log at any time.

The log is what `job` keeps, by day and batch. An advance reads the batches above the mark, adds their sums to the months that they touch,
however long ago those are, and writes these months anew under the number of the last batch. The marks, which version of each month counts
and up to which batch, are written last and in one file: until then the old versions count, so a crash at any point changes nothing, and the
next advance does the same again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import alerts, rollups

KEYS = ["sub_id", "yyyymm"]
MARKS = "yyyymm string, version bigint, upto bigint"
SUMS = ["total_used", "plan_used", "member_family_used", "gift_used", "overflow_used"]
TOTALS = "sub_id bigint, " + ", ".join(f"{c} bigint" for c in SUMS) + ", yyyymm string, version bigint"


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def marks(spark: SparkSession, target: str) -> tuple[int, dict[str, int]]:
    """The last batch that the totals hold, and the version of each month that counts: as many rows as there are months."""
    rows = _table(spark, f"{target}/marks", MARKS)
    upto = rows.agg(F.max("upto")).first()[0]
    return (-1, {}) if upto is None else (upto, {r.yyyymm: r.version for r in rows.where(F.col("upto") == upto).collect()})


def totals(spark: SparkSession, target: str) -> DataFrame:
    """The totals as they stand: (sub_id, yyyymm, sums)."""
    return _of_months(spark, target, marks(spark, target)[1]).drop("version")


def _of_months(spark: SparkSession, target: str, versions: dict[str, int]) -> DataFrame:
    condition = F.lit(False)
    for month, version in versions.items():
        condition = condition | ((F.col("yyyymm") == month) & (F.col("version") == version))
    return _table(spark, f"{target}/totals", TOTALS).where(condition)


def advance(spark: SparkSession, log: str, target: str, most: int | None = None) -> int:
    """Adds the batches above the mark, up to `most`; gives the new mark. log: the folder of applied rows."""
    upto, versions = marks(spark, target)
    rows = spark.read.parquet(log).where(F.col("batch_id") > upto)
    if most is not None:
        rows = rows.where(F.col("batch_id") <= most)
    last = rows.agg(F.max("batch_id")).first()[0]
    if last is None:
        return upto
    rows = rows.where(F.col("batch_id") <= last).withColumn("yyyymmdd", F.col("yyyymmdd").cast("string"))
    news = rollups.rebuild(alerts.applied_log(rows)).select(*KEYS, *SUMS)
    touched = {r[0] for r in rows.select("yyyymm").distinct().collect()}
    old = _of_months(spark, target, {m: v for m, v in versions.items() if m in touched}).select(*KEYS, *SUMS)
    sums = old.unionByName(news).groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])
    sums.withColumn("version", F.lit(last).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm", "version").parquet(f"{target}/totals")
    now = spark.createDataFrame([(m, v) for m, v in (versions | dict.fromkeys(touched, last)).items()], "yyyymm string, version bigint")
    now.coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/upto={last}")
    return last
