"""A database table that grows, as a streaming source.

``spark.readStream.format("polled_table")`` reads any database with a Python
driver of the DB-API.  Offsets are keys (time, asset), kept by Spark in the
checkpoint of the query; a micro-batch holds the rows whose key lies above the
last offset and up to the next, at most ``max_rows`` of them or, where one key
has more, all rows of that key, so a page never ends inside a key.

The driver asks the database for keys only: the key that ends a page and those
that cut it into ``tasks`` ranges of about equal size.  The rows are read by the
tasks, each with a connection and a key range of its own, as Arrow batches.

A source that is started again has to bound its next page without being told
where the last one ended.  Spark plans a page after it has written its offset
and before it commits it, so the end of the last planned page, kept in the file
``cursor``, is the offset that a restarted query continues from; a page that
was planned and not committed is planned again first.

Rows without a time have no place in the order.  They are never part of a page;
``rows_without_time`` counts them.  Rows without an asset are read, ordered as
if the asset were the empty text.  A row that is inserted behind the offset is
not seen any more.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from fleetpulse.config import SENSORS

FETCH = 10_000


@dataclass
class KeyRange(InputPartition):
    """Keys above ``after`` (None: from the start) and up to ``upto``."""

    after: list | None
    upto: list


@dataclass(frozen=True)
class Table:
    """Where a table is and how its columns are called; ``connect`` is ``module:function`` of a DB-API driver."""

    connect: str
    arguments: str
    table: str
    time: str = "ts"
    asset: str = "asset_id"

    def module(self):
        return importlib.import_module(self.connect.partition(":")[0])

    def connection(self):
        return getattr(self.module(), self.connect.partition(":")[2] or "connect")(**json.loads(self.arguments))

    @property
    def key(self) -> str:
        return f"({self.time}, coalesce({self.asset}, ''))"

    def where(self, after: list | None, upto: list | None) -> tuple[str, list]:
        """Condition on the key with the driver's own place holders."""
        mark = "?" if self.module().paramstyle == "qmark" else "%s"
        parts, values = [f"{self.time} IS NOT NULL"], []
        for sign, bound in ((">", after), ("<=", upto)):
            if bound is not None:
                parts.append(f"{self.key} {sign} ({mark}, {mark})")
                values += bound
        return " AND ".join(parts), values

    def key_at(self, connection, after: list | None, upto: list | None, place: int) -> list | None:
        """Key of the row at this place (from 0) of a range in key order; None beyond its end."""
        where, values = self.where(after, upto)
        order = f"{self.time}, coalesce({self.asset}, '')"
        rows = self.ask(connection, f"SELECT {order} FROM {self.table} WHERE {where} ORDER BY {order} LIMIT 1 OFFSET {place}", values)
        return [plain(v) for v in rows[0]] if rows else None

    def last_key(self, connection, after: list | None) -> list | None:
        where, values = self.where(after, None)
        order = f"{self.time} DESC, coalesce({self.asset}, '') DESC"
        rows = self.ask(connection, f"SELECT {self.time}, coalesce({self.asset}, '') FROM {self.table} WHERE {where} ORDER BY {order} LIMIT 1", values)
        return [plain(v) for v in rows[0]] if rows else None

    def count(self, connection, after: list | None, upto: list | None) -> int:
        where, values = self.where(after, upto)
        return self.ask(connection, f"SELECT count(*) FROM {self.table} WHERE {where}", values)[0][0]

    @staticmethod
    def ask(connection, query: str, values: list) -> list[tuple]:
        cursor = connection.cursor()
        try:
            cursor.execute(query, values)
            return cursor.fetchall()
        finally:
            cursor.close()


def plain(value: Any) -> Any:
    """A key value as it can be kept in an offset and given back to the database."""
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else value


class PolledTable(DataSource):
    """Options: connect, arguments (JSON), table, time, asset, columns (name as column), max_rows, tasks, cursor."""

    @classmethod
    def name(cls) -> str:
        return "polled_table"

    def schema(self) -> str:
        return ", ".join(["asset_id string", "ts timestamp", *(f"{s} double" for s in SENSORS)])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PolledReader(self.options, schema)


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.table = Table(options["connect"], options["arguments"], options["table"], options.get("time", "ts"), options.get("asset", "asset_id"))
        named = json.loads(options.get("columns", "{}"))
        self.columns = [named.get(n, {"ts": self.table.time, "asset_id": self.table.asset}.get(n, n)) for n in schema.names]
        self.schema = schema
        self.max_rows, self.tasks = int(options.get("max_rows", 5000)), int(options.get("tasks", 8))
        self.cursor = options["cursor"]
        self.reached = self._stored()

    # -- on the driver -----------------------------------------------------

    def initialOffset(self) -> dict:
        return {"key": None}

    def latestOffset(self) -> dict:
        """End of the next page after the last planned one."""
        connection = self.table.connection()
        try:
            end = self.table.key_at(connection, self.reached, None, self.max_rows - 1) or self.table.last_key(connection, self.reached)
        finally:
            connection.close()
        return {"key": end or self.reached}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        self.reached = end["key"]
        self._store(self.reached)
        if end["key"] is None or start["key"] == end["key"]:
            return [KeyRange(end["key"] or ["", ""], end["key"] or ["", ""])]
        connection = self.table.connection()
        try:
            n = self.table.count(connection, start["key"], end["key"])
            places = sorted({n * i // self.tasks for i in range(1, self.tasks)} - {0})
            cuts = [self.table.key_at(connection, start["key"], end["key"], p - 1) for p in places]
        finally:
            connection.close()
        # Keys with many rows may end several ranges; each is one range then.
        ends = [c for i, c in enumerate(cuts) if c is not None and c != end["key"] and c not in cuts[:i]] + [end["key"]]
        return [KeyRange(a, b) for a, b in zip([start["key"], *ends[:-1]], ends)]

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.cursor) if "://" in self.cursor else (fs.LocalFileSystem(), self.cursor.removeprefix("file:"))

    def _stored(self) -> list | None:
        system, path = self._place()
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as file:
            return json.loads(file.read())

    def _store(self, key: list | None) -> None:
        """Written beside and moved, so that a reader finds the old or the new cursor."""
        system, path = self._place()
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.new") as file:
            file.write(json.dumps(key).encode())
        system.move(f"{path}.new", path)

    # -- in the tasks ------------------------------------------------------

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if partition.after == partition.upto:
            return
        where, values = self.table.where(partition.after, partition.upto)
        connection = self.table.connection()
        cursor = connection.cursor()
        try:
            cursor.execute(f"SELECT {', '.join(self.columns)} FROM {self.table.table} WHERE {where}", values)
            while rows := cursor.fetchmany(FETCH):
                yield batch_of(rows, self.schema)
        finally:
            cursor.close()
            connection.close()


def batch_of(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    """Rows of a driver as Arrow columns; times may be text or date-times, in UTC."""
    columns = []
    for field, values in zip(schema.fields, zip(*rows)):
        kind = field.dataType.typeName()
        if kind == "timestamp":
            moments = [datetime.fromisoformat(v) if isinstance(v, str) else v for v in values]
            columns.append(pa.array(moments, pa.timestamp("us", "UTC")) if any(m and m.tzinfo for m in moments)
                           else pa.array(moments, pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
        elif kind == "double":
            columns.append(pa.array([None if v is None else float(v) for v in values], pa.float64()))
        else:
            columns.append(pa.array([None if v is None else str(v) for v in values], pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def poll_table(spark: SparkSession, table: Table, cursor: str, max_rows: int = 5000, tasks: int = 8, columns: dict[str, str] | None = None) -> DataFrame:
    """New readings of a table as a stream; ``cursor`` is a file beside the checkpoint, one for each query."""
    spark.dataSource.register(PolledTable)
    options = {
        "connect": table.connect, "arguments": table.arguments, "table": table.table, "time": table.time, "asset": table.asset,
        "columns": json.dumps(columns or {}), "max_rows": str(max_rows), "tasks": str(tasks), "cursor": cursor,
    }
    return spark.readStream.format(PolledTable.name()).options(**options).load()


def rows_without_time(table: Table) -> int:
    """Rows that no page will ever hold."""
    connection = table.connection()
    try:
        return table.ask(connection, f"SELECT count(*) FROM {table.table} WHERE {table.time} IS NULL", [])[0][0]
    finally:
        connection.close()
