import json

import pytest
from pyspark.sql import functions as F

from strataq.sources import readers as R
from strataq.sources import sinks as K
from strataq.streaming import windows as S


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b\n1,x\n2,\n")
    df = R.strict_csv(spark, str(p), ["a", "b"])
    assert df.dtypes == [("a", "string"), ("b", "string")] and df.count() == 2 and R.truncated(df, 1)[1] and not R.truncated(df, 2)[1]
    with pytest.raises(ValueError):
        R.strict_csv(spark, str(p), ["b", "a"])
    p.write_text("a, b\n1,2\n")
    with pytest.raises(ValueError):
        R.strict_csv(spark, str(p))
    p.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        R.strict_csv(spark, str(p)).collect()


def test_blobs(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    b = R.blobs(spark, str(tmp_path))
    r = b.collect()[0]
    want = spark.createDataFrame([("x.bin", r.sha256), ("y.bin", "0")], "name string, sha256 string")
    assert {x.name: x.intact for x in R.verified(b, want).collect()} == {"x.bin": True, "y.bin": False}


def test_geojson(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    make = lambda kind, c: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {}}
    text = json.dumps({"type": "FeatureCollection", "features": [make("Point", [10, 20]), make("Point", [200, 0]), make("Polygon", [ring]), make("Polygon", [ring[:3]]), make("LineString", ring)]})
    out = R.geojson(spark.createDataFrame([(text,)], "g string"), "g").orderBy("feature").collect()
    assert [r.fault for r in out] == [None, "outside_the_globe", None, "open_ring", "unsupported_geometry"] and out[2].vertices == 4


def test_admission(spark, tmp_path):
    base = dict(
        entity="e", endpoint="x", timezone="UTC", source_id="s", split="train", contract="above 85", source_span="85", predicate="greater_than", threshold=85.0, unit="F", event_time="2024-01-03T00:00:00Z",
        rules_available_at="2024-01-01T00:00:00Z", observed_at="2024-01-01T00:00:00Z", available_at="2024-01-01T01:00:00Z", cutoff="2024-01-02T00:00:00+00:00", resolved_at="2024-01-04T00:00:00Z", price=0.4, label=1,
    )
    rows = [base | dict(id="1", event_group="a"), base | dict(id="2", event_group="b"), base | dict(id="3", event_group="b", price=1.5, observed_at="2024-01-01T00:00:00"), base | dict(id="3", event_group="c", available_at="2024-01-05T00:00:00Z")]
    p = tmp_path / "pack.json"
    p.write_text(json.dumps({"domain": "d", "synthetic": True, "provenance": {}, "rows": rows}))
    pack = R.prepared_pack(spark, str(p))
    got = sorted((r.id, r.event_group, tuple(r.faults)) for r in R.admit(pack).collect())
    assert got == [("1", "a", ()), ("2", "b", ()), ("3", "b", ("repeated_id", "price", "time_text", "observed_late")), ("3", "c", ("repeated_id", "available_late"))]
    assert not set(R.prediction_rows(pack).columns) & set(R.PROTECTED)


def test_append_and_trajectory(spark, tmp_path):
    rec = spark.createDataFrame([("k", "{1}"), ("k", "{1}"), ("m", "{2}")], "kind string, data string")
    path = str(tmp_path / "log")
    assert K.append_new(rec, path) == 2 and K.append_new(rec, path) == 0 and spark.read.parquet(path).count() == 2
    long = spark.createDataFrame([(0.0, "b", 0, "x", 1.0), (0.0, "b", 0, "y", 2.0)], "time double, scenario string, replicate int, state string, value double")
    wide = K.trajectory(long, ["x", "y"])
    assert wide.columns == ["time", "scenario", "replicate", "x", "y"]
    K.write_case_csv(wide.withColumn("z", F.lit(None).cast("double")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).collect()[0].z is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", f"2024-01-01 00:{m:02d}:30", "a" if m % 2 else "b", float(m)) for m in range(60)]
    df = spark.createDataFrame(rows, "ts string, seen string, g string, v double").select(F.col("ts").cast("timestamp"), F.col("seen").cast("timestamp"), "g", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    checked = S.rolling_bounds(S.admitted(stream, "ts", "seen", "1 minute").drop("seen"), "ts", "g", "v", 0.0, 50.0, "10 minutes")
    q = checked.writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("rolled").collect())
    batch = df.groupBy(F.window("ts", "10 minutes"), "g").agg(F.count("*"), F.count_if(F.col("v") > 50), F.max(F.greatest(F.lit(0.0), F.col("v") - 50)))
    assert got == sorted((r[0].start, r[0].end, *tuple(r)[1:]) for r in batch.collect()) and sum(r[4] for r in got) == 9


def test_latest_survives_a_replay(spark, tmp_path):
    put = S.upsert_latest(str(tmp_path / "t"))
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 2, "z")], "k int, t int, v string")
    for df, epoch in ((a, 0), (b, 1), (b, 1)):
        put(df, epoch)
    assert {r.k: r.v for r in S.latest(spark.read.parquet(str(tmp_path / "t")), "k", "t").collect()} == {1: "z", 2: "y"}
