"""Micro-batches that are repeated, empty or merged are in the log once."""

from __future__ import annotations

import pytest

from fleetpulse.streaming.sink import MANIFEST, BatchLog

SCHEMA = "batch int, x long"


def rows(spark, i, n=3):
    return spark.createDataFrame([(i, i * 100 + j) for j in range(n)], SCHEMA).coalesce(1)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_folders_do_not_grow_with_batches(spark, tmp_path):
    log = BatchLog(spark, f"{tmp_path}/log", schema(spark), every=3)
    most = 0
    for i in range(40):
        log.write(rows(spark, i, 0 if i % 5 == 4 else 3), i)
        if i % 7 == 0:
            log.write(rows(spark, i), i)
        most = max(most, len([p for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")]))
    want = {(i, i * 100 + j) for i in range(40) if i % 5 != 4 or i % 7 == 0 for j in range(3)}
    got = [tuple(r) for r in log.read().collect()]
    assert len(got) == len(want) and set(got) == want
    assert most <= 12  # three or four levels of at most three folders, the batches and a manifest
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith(MANIFEST)]) == 1
    assert log.manifest().upto >= 30


def test_a_batch_repeated_after_it_was_merged_is_not_doubled(spark, tmp_path):
    log = BatchLog(spark, f"{tmp_path}/log", schema(spark), every=2)
    for i in range(4):
        log.write(rows(spark, i), i)
    assert log.manifest().upto >= 1
    log.write(rows(spark, 0), 0)
    log.write(rows(spark, 3), 3)
    assert log.read().count() == 12


@pytest.mark.parametrize("stops_at", ["rewrite", "manifest", "delete"])
def test_a_merge_that_stops_half_way_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stops_at):
    log = BatchLog(spark, f"{tmp_path}/log", schema(spark), every=2)
    log.write(rows(spark, 0), 0)
    log.write(rows(spark, 1), 1)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if stops_at == "rewrite":
            m.setattr(BatchLog, "_rewrite", stop)
        else:
            m.setattr(log.folder, "write" if stops_at == "manifest" else "delete", stop)
        with pytest.raises(KeyboardInterrupt):
            log.write(rows(spark, 2), 2)
    again = BatchLog(spark, f"{tmp_path}/log", schema(spark), every=2)
    assert sorted(r.x for r in again.read().collect()) == [0, 1, 2, 100, 101, 102, 200, 201, 202]
    again.write(rows(spark, 2), 2)
    again.write(rows(spark, 3), 3)
    assert again.read().count() == 12


def test_empty_log(spark, tmp_path):
    assert BatchLog(spark, f"{tmp_path}/none", schema(spark)).read().count() == 0
    with pytest.raises(ValueError, match="no batch"):
        BatchLog(spark, f"{tmp_path}/none").read()
    with pytest.raises(ValueError):
        BatchLog(spark, f"{tmp_path}/none", every=1)
