"""Relational targets by Spark's Python data source API: a batch's rows appear in one transaction, once, however often the batch comes.

Tasks write their rows to a staging table under the batch and their own number, each in a transaction of its own, in place of what an earlier
attempt of theirs had left there. When all have, the driver moves them to the target and notes the batch, in one transaction; a batch that is
noted already is left alone. So of two databases that a batch goes to one after the other, each has the batch whole or not at all, and after
a crash between them the batch comes again and reaches the one that lacks it.

Connections are made by a function of the DB-API kind, named `module:function` and called with the option `database`, so any driver will do
whose parameters are written `?` (option `mark` for others). Needed tables: the target; `<target>_stage` with its columns, batch and task
before them; `batches` (target, batch). `tables` writes their definitions.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = 1000
#: SQL kinds by Spark's; others are text.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE PRECISION", "timestamp_ntz": "TIMESTAMP"}


def tables(df: DataFrame, target: str, key: str) -> list[str]:
    """Definitions of the tables that df's rows need."""
    columns = ", ".join(f"{name} {KINDS.get(kind, 'VARCHAR(4000)')}" for name, kind in df.dtypes)
    return [
        f"CREATE TABLE IF NOT EXISTS {target} ({columns}, PRIMARY KEY ({key}))",
        f"CREATE TABLE IF NOT EXISTS {target}_stage (batch BIGINT, task BIGINT, {columns})",
        "CREATE TABLE IF NOT EXISTS batches (target VARCHAR(200), batch BIGINT, PRIMARY KEY (target, batch))",
    ]


@dataclass
class Staged(WriterCommitMessage):
    task: int
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.connect_name, self.database, self.target, self.key = (options[k] for k in ("connect", "database", "target", "key"))
        self.batch, self.mark = int(options["batch"]), options.get("mark", "?")
        self.columns = schema.fieldNames()

    def _connection(self):
        module, name = self.connect_name.split(":")
        return getattr(importlib.import_module(module), name)(self.database)

    def _sql(self, text: str) -> str:
        return text.replace("?", self.mark)

    def write(self, iterator: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        insert = self._sql(f"INSERT INTO {self.target}_stage (batch, task, {', '.join(self.columns)}) VALUES ({', '.join('?' * (2 + len(self.columns)))})")
        connection = self._connection()
        try:
            cursor = connection.cursor()
            cursor.execute(self._sql(f"DELETE FROM {self.target}_stage WHERE batch = ? AND task = ?"), (self.batch, task))
            rows: list[tuple] = []
            for row in iterator:
                rows.append((self.batch, task, *(str(v) if hasattr(v, "isoformat") else v for v in row)))
                n += 1
                if len(rows) == ROWS:
                    cursor.executemany(insert, rows)
                    rows = []
            if rows:
                cursor.executemany(insert, rows)
            connection.commit()
        finally:
            connection.close()
        return Staged(task, n)

    def commit(self, messages: list[Staged | None]) -> None:
        names = ", ".join(self.columns)
        connection = self._connection()
        try:
            cursor = connection.cursor()
            cursor.execute(self._sql("SELECT count(*) FROM batches WHERE target = ? AND batch = ?"), (self.target, self.batch))
            if not cursor.fetchone()[0]:
                # only rows of tasks that have ended well, and keys that no other batch has brought
                written = ", ".join(str(m.task) for m in messages if m is not None) or "-1"
                cursor.execute(
                    self._sql(
                        f"INSERT INTO {self.target} ({names}) SELECT {names} FROM {self.target}_stage s WHERE batch = ? AND task IN ({written}) "
                        f"AND NOT EXISTS (SELECT 1 FROM {self.target} t WHERE t.{self.key} = s.{self.key})"
                    ),
                    (self.batch,),
                )
                cursor.execute(self._sql("INSERT INTO batches (target, batch) VALUES (?, ?)"), (self.target, self.batch))
            cursor.execute(self._sql(f"DELETE FROM {self.target}_stage WHERE batch = ?"), (self.batch,))
            connection.commit()
        finally:
            connection.close()

    def abort(self, messages: list[Staged | None]) -> None:
        """Staged rows of a batch that failed stay until it comes again and replaces them."""


class BatchDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_database"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema)


def append(df: DataFrame, connect: str, database: str, target: str, key: str, batch_id: int) -> None:
    """df's rows into a table, under a batch; rows whose key repeats in df or is there already are left out."""
    df.sparkSession.dataSource.register(BatchDatabase)
    rows = df.dropDuplicates([key])
    rows.write.format("batch_database").mode("append").options(connect=connect, database=database, target=target, key=key, batch=str(batch_id)).save()


def defined(spark: SparkSession, df: DataFrame, connect: str, database: str, target: str, key: str) -> None:
    """Makes the tables that are not there yet."""
    module, name = connect.split(":")
    connection = getattr(importlib.import_module(module), name)(database)
    try:
        for text in tables(df, target, key):
            connection.cursor().execute(text)
        connection.commit()
    finally:
        connection.close()
