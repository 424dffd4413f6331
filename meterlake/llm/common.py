"""Helpers shared by the corpus operators: tables, the shared work folder, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the documents table; extra columns of an input are carried along untouched.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset
    in local mode (tests). It goes when the application ends."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="meterlake-"))
            base = context.getCheckpointDir()
        _folders[app] = f"{base.rstrip('/')}/meterlake-{app}"
        atexit.register(_deleted, spark, _folders[app])
    return _folders[app]


def _deleted(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the application has stopped before the process
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, release: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads survive lost executors and nothing is computed twice.

    release: let go of shuffle files at once; for tables whose making moved little it isn't worth the pause.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        released(spark)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to any more; it acts when the driver collects garbage.

    Twice: the first collection lets go of the query that has ended, the second of what it held.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row(rows: DataFrame, ddl: str) -> T.StructType:
    """The schema of rows' struct column `row` and of columns made beside it; names of the struct's fields may be any."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(ddl).fields])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, *without: str) -> Column:
    """A struct of all columns but some, so that no column of an input meets a name that an operator uses; `row.*` takes it apart."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without])


def bind(expr: Column, body) -> Column:
    """body(value of expr), with expr evaluated once a row; the optimiser would copy a projected column into lambdas."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def blank_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
