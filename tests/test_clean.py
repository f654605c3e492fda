from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import clean
from fleetpulse.plans.building import build_features
from fleetpulse.sources import readings as sources
from helpers import minute, readings


def dirty(spark):
    nan = float("nan")
    rows = [
        ("a", minute(0), 1.0, 1.0, 20.0),
        ("a", minute(1), 2.0, 2.0, 20.0),
        ("a", minute(1), 1.5, 2.0, 20.0),
        ("a", minute(2), None, 1.0, 20.0),
        ("a", minute(3), nan, 1.0, 20.0),
        ("a", minute(4), -1.0, 1.0, 20.0),
        ("a", minute(5), 1.0, 1.0, -50.0),
        ("a", minute(6), 1.0, 1.0, 300.0),
        ("a", minute(7), 1.0, 1.0, 299.9),
        ("b", minute(1), 0.0, 0.0, -49.9),
        ("b", None, 1.0, 1.0, 20.0),
        ("b", None, 2.0, 1.0, 20.0),
    ]
    return spark.createDataFrame(rows, sources.READING_SCHEMA)


def test_clean(spark):
    rows = {(r["asset_id"], r["ts"]): r["vibration"] for r in clean.clean_readings(dirty(spark)).collect()}
    assert rows == {
        ("a", minute(0)): 1.0, ("a", minute(1)): 1.5, ("a", minute(7)): 1.0, ("b", minute(1)): 0.0, ("b", None): 1.0,
    }
    counters = clean.cleaning_counters(dirty(spark)).first().asDict()
    assert counters == {"n_raw": 12, "n_duplicate": 2, "n_missing_sensor": 2, "n_impossible": 3, "n_clean": 5}


def test_clean_sorted_is_the_same(spark):
    known = dirty(spark).filter(F.col("ts").isNotNull())
    values = known.select("asset_id", "ts", *[F.when(~F.isnan(s), F.col(s)).alias(s) for s in ("vibration", "current", "temperature")])
    a = clean.clean_readings(known).collect()
    b = clean.clean_sorted(values, ["asset_id"]).collect()
    assert sorted(a) == sorted(b)
    assert build_features(dirty(spark)).count() == 0


def test_rating_is_inclusive(spark):
    df = readings(spark, {"a": [(3.0, 6.0, 50.0), (3.0001, 6.0, 50.0), (3.0, 6.1, 50.0), (3.0, 6.0, 50.1)]})
    assert clean.spec_normal(df).count() == 1
    own = spark.createDataFrame([("a", 4.0, None, None)], "asset_id string, vibration_limit double, current_limit double, temperature_limit double")
    assert clean.spec_normal(df, limits=own).count() == 2
    rate = clean.spec_pass_rate(df).first()
    assert (rate["n_normal"], rate["pass_rate"], rate["is_empty"]) == (1, 0.25, False)


def test_labels(spark):
    df = readings(spark, {"a": [(1.0, 1.0, 1.0)] * 3}).withColumn("health_status", F.lit(" Warning "))
    assert {r[0] for r in clean.validate_labels(df).select("health_status").collect()} == {"warning"}
    with pytest.raises(ValueError, match="health_status"):
        clean.validate_labels(df.drop("health_status"))
    for bad in (F.lit("odd"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="unsupported health_status"):
            clean.validate_labels(df.withColumn("health_status", bad)).collect()


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        "health_status,timestamp,temperature_c,vibration_mps2,current_ampere\n"
        "normal,2024-01-01 00:00:00,20,1.5,2\ncritical,not a time,x,1,2\n"
    )
    df = sources.read_csv(spark, str(path), "m1")
    assert df.columns == ["asset_id", "ts", "vibration", "current", "temperature"]
    first, second = df.collect()
    assert (first["asset_id"], first["ts"], first["vibration"]) == ("m1", minute(0), 1.5)
    assert second["ts"] is None and second["temperature"] is None
    assert sources.read_labelled_csv(spark, str(path)).columns[-1] == "health_status"
    (tmp_path / "bad.csv").write_text("timestamp,vibration_mps2\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="current_ampere"):
        sources.read_csv(spark, str(tmp_path / "bad.csv"))


def test_jdbc(spark):
    url = "jdbc:derby:memory:fleet;create=true"
    rows = [(minute(i), 1.0 + i, 2.0, 30.0) for i in range(6)]
    table = spark.createDataFrame(rows, "timestamp timestamp, vibration_mps2 double, current_ampere double, temperature_c double")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    table.write.jdbc(url, "readings", mode="overwrite", properties=driver)
    got = sources.read_jdbc_new_rows(spark, url, "readings", since="2024-01-01 00:01:00", limit=3, properties=driver)
    assert [(r["ts"], r["vibration"]) for r in got.collect()] == [(minute(i), 1.0 + i) for i in (2, 3, 4)]


def test_new_rows_and_split(spark):
    df = readings(spark, {"a": [(1.0, 1.0, 1.0)] * 8, "b": [(1.0, 1.0, 1.0)] * 3})
    assert sources.read_new_rows(df, minute(2), limit=4).count() == 4
    from dataclasses import replace

    first, rest = clean.split_commissioning(df, replace(clean.DEFAULT, commissioning_rows=5))
    assert (first.count(), rest.count()) == (8, 3)
    semi, anti = clean.split_by_membership(df, df.filter("asset_id = 'b'"))
    assert (semi.count(), anti.count()) == (3, 8)


def test_split_keeps_every_row(spark):
    """Rows without a time or an asset, shared times, and several hours."""
    from dataclasses import replace

    from fleetpulse.sources.readings import READING_SCHEMA

    df = readings(spark, {"a": [(1.0, 1.0, 1.0)] * 200, "b": [(1.0, 1.0, 1.0)] * 3})
    odd = [(None, minute(i), 1.0, 1.0, 1.0) for i in range(70)] + [("a", None, 1.0, 1.0, 1.0)] * 2 + [("a", minute(64), 2.0, 1.0, 1.0)]
    df = df.unionByName(spark.createDataFrame(odd, READING_SCHEMA))
    first, rest = clean.split_commissioning(df, replace(clean.DEFAULT, commissioning_rows=65))
    counts = [{r["asset_id"]: r["count"] for r in d.groupBy("asset_id").count().collect()} for d in (first, rest)]
    assert counts == [{"a": 66, "b": 3, None: 65}, {"a": 137, None: 5}]


def test_pages_lose_no_shared_timestamps(spark):
    df = readings(spark, {a: [(1.0, 1.0, 1.0)] * 3 for a in "abcd"})
    pages = [page.collect() for page in sources.read_pages(df, limit=3)]
    assert [len(p) for p in pages] == [4, 4, 4]
    assert len({(r.asset_id, r.ts) for p in pages for r in p}) == 12
