"""Float bundles: round trips, ranges of records, and writes that fail."""

import json

import numpy as np
import pytest
from gristmill.sources import bundles
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.fixture
def rows(spark):
    bundles.register(spark)
    rng = np.random.default_rng(0)
    data = [(k - 50, [float(np.float32(x)) for x in rng.normal(size=6)], float(k) / 4) for k in range(300)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, score float").repartition(5)


def read(spark, path):
    return sorted(tuple(r) for r in spark.read.format("floatbundle").load(path).collect())


def test_round_trip_append_and_overwrite(spark, rows, tmp_path):
    data, df = rows
    path = str(tmp_path / "b")
    df.write.format("floatbundle").mode("append").save(path)
    assert read(spark, path) == sorted(data)
    assert spark.read.format("floatbundle").load(path).dtypes == [("vec_id", "bigint"), ("embedding", "array<float>"), ("score", "float")]
    df.where("vec_id < 0").write.format("floatbundle").mode("append").save(f"file://{path}")
    assert len(read(spark, path)) == 350
    df.where("vec_id >= 200").withColumn("score", F.col("score").cast("double")).write.format("floatbundle").mode("overwrite").save(path)
    assert read(spark, path) == sorted(r for r in data if r[0] >= 200)
    manifest = json.loads((tmp_path / "b" / "manifest.json").read_text())
    assert {f.name for f in (tmp_path / "b").iterdir() if not f.name.startswith(".")} == {"manifest.json", *(f["name"] for f in manifest["files"])}  # old files are gone
    df.limit(0).write.format("floatbundle").mode("overwrite").save(path)
    assert read(spark, path) == []


def test_a_failed_task_leaves_the_bundle_as_it_was(spark, rows, tmp_path):
    data, df = rows
    path = tmp_path / "b"
    df.write.format("floatbundle").mode("append").save(str(path))
    before = sorted(f.name for f in path.iterdir())
    bad = [df.withColumn("embedding", F.when(F.col("vec_id") == 7, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))), df.withColumn("score", F.when(F.col("vec_id") != 3, F.col("score")))]
    for broken in bad:
        for mode in ("append", "overwrite"):
            with pytest.raises(PySparkException):
                broken.write.format("floatbundle").mode(mode).save(str(path))
            assert sorted(f.name for f in path.iterdir()) == before and read(spark, str(path)) == sorted(data)
    with pytest.raises(PySparkException):  # each task is right, but not of the bundle's width
        df.withColumn("embedding", F.slice("embedding", 1, 2)).write.format("floatbundle").mode("append").save(str(path))
    assert sorted(f.name for f in path.iterdir()) == before and read(spark, str(path)) == sorted(data)


def test_what_is_no_bundle(spark, rows, tmp_path):
    _, df = rows
    with pytest.raises(PySparkException):
        df.select("embedding", "vec_id").write.format("floatbundle").mode("append").save(str(tmp_path / "c"))
    with pytest.raises(PySparkException):
        spark.read.format("floatbundle").load(str(tmp_path / "none")).count()


def test_ranges_of_records(rows, spark, tmp_path, monkeypatch):
    data, df = rows
    path = str(tmp_path / "b")
    df.coalesce(1).write.format("floatbundle").mode("append").save(path)
    monkeypatch.setattr(bundles, "SPLIT", 70)
    monkeypatch.setattr(bundles, "BATCH", 32)
    reader = bundles._Reader(path)
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 70), (70, 140), (140, 210), (210, 280), (280, 300)]
    got = [r for p in reversed(parts) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((k, v, s) for k, v, s in got) == sorted(data)
