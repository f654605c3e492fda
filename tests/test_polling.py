"""A growing database table as a stream: pages, restarts, ties, rows without a place."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from fleetpulse.sources.polling import KeyRange, PolledReader, Table, poll_table, rows_without_time
from fleetpulse.sources.readings import READING_SCHEMA

COLUMNS = "asset_id TEXT, ts TEXT, vibration REAL, current REAL, temperature REAL"


@pytest.fixture
def database(tmp_path):
    connection = sqlite3.connect(f"{tmp_path}/t.db")
    connection.execute(f"CREATE TABLE readings ({COLUMNS})")
    yield connection
    connection.close()


def table(tmp_path) -> Table:
    return Table("sqlite3:connect", json.dumps({"database": f"{tmp_path}/t.db"}), "readings")


def add(connection, rows) -> None:
    connection.executemany("INSERT INTO readings VALUES (?, ?, ?, ?, ?)", rows)
    connection.commit()


def reading(i: int, second: int | None = None, asset: str | None = "a"):
    second = i if second is None else second
    return (asset, f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}", float(i), 1.0, None if i % 5 == 0 else 2.0)


def options(tmp_path, max_rows: int, tasks: int = 3) -> dict[str, str]:
    t = table(tmp_path)
    return {"connect": t.connect, "arguments": t.arguments, "table": t.table, "max_rows": str(max_rows), "tasks": str(tasks), "cursor": f"{tmp_path}/c/cursor.json"}


def drained(reader: PolledReader, start: dict) -> list[tuple[dict, list[float]]]:
    """Pages as Spark would ask for them until one is empty."""
    pages = []
    while (end := reader.latestOffset()) != start:
        rows = [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column(2).to_pylist()]
        pages.append((end, sorted(rows)))
        start = end
    return pages


def test_pages_end_on_whole_keys_and_lose_nothing(tmp_path, database):
    add(database, [reading(i, i // 4, f"a{i % 2}") for i in range(200)])  # two rows a key
    add(database, [reading(1000 + i, 20, "a0") for i in range(37)])  # one key larger than a page
    add(database, [reading(2000, 7, None), reading(2001, 7, None)])
    add(database, [("a", None, 3.0, 1.0, 1.0)])
    pages = drained(PolledReader(options(tmp_path, 15), READING_SCHEMA), {"key": None})
    every = [v for _, rows in pages for v in rows]
    assert sorted(every) == sorted([*map(float, range(200)), *map(float, range(1000, 1037)), 2000.0, 2001.0])
    large = [len(rows) for _, rows in pages if len(rows) > 16]
    assert len(large) == 1 and large[0] >= 37
    assert rows_without_time(table(tmp_path)) == 1


def test_ranges_cover_a_page_once(tmp_path, database):
    add(database, [reading(i, i // 3) for i in range(100)])
    reader = PolledReader(options(tmp_path, 1000, tasks=7), READING_SCHEMA)
    ranges = reader.partitions({"key": None}, reader.latestOffset())
    assert len(ranges) == 7
    held = [[v for b in reader.read(r) for v in b.column(2).to_pylist()] for r in ranges]
    assert sorted(sum(held, [])) == [float(i) for i in range(100)] and max(map(len, held)) <= 100 / 7 + 6


def test_empty_table_and_nothing_new(tmp_path, database):
    reader = PolledReader(options(tmp_path, 10), READING_SCHEMA)
    assert reader.initialOffset() == reader.latestOffset() == {"key": None}
    assert [b for r in reader.partitions({"key": None}, {"key": None}) for b in reader.read(r)] == []
    assert list(reader.read(KeyRange(["x", ""], ["x", ""]))) == []


def test_a_new_reader_goes_on_from_the_last_planned_page(tmp_path, database):
    add(database, [reading(i) for i in range(50)])
    first = PolledReader(options(tmp_path, 20), READING_SCHEMA)
    end = first.latestOffset()
    first.partitions({"key": None}, end)
    again = PolledReader(options(tmp_path, 20), READING_SCHEMA)
    assert again.latestOffset()["key"][0].endswith("00:39")
    # A page that was planned and not committed is planned again and then continued.
    again.partitions({"key": None}, end)
    assert again.latestOffset()["key"][0].endswith("00:39")


def test_restarted_streams_read_every_row_once(spark, tmp_path, database):
    def run() -> list[int]:
        rows = poll_table(spark, table(tmp_path), f"{tmp_path}/cursor.json", max_rows=60, tasks=2)
        query = (
            rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
            .trigger(processingTime="0 seconds").start()
        )
        query.processAllAvailable()
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        return sizes

    add(database, [reading(i) for i in range(130)])
    assert run() == [60, 60, 10]
    assert run() == []
    add(database, [reading(i) for i in range(130, 200)])
    assert run() == [60, 10]
    out = spark.read.parquet(f"{tmp_path}/out")
    row = out.agg(F.count("*"), F.count_distinct("vibration"), F.sum("vibration"), F.count("temperature"), F.max(F.date_format("ts", "mm:ss"))).first()
    assert tuple(row) == (200, 200, 19900.0, 160, "03:19")
