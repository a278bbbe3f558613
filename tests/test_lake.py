import pytest
from pyspark.sql import functions as F

from sluice.sources.lake import Lake, checksums
from sluice.streaming import ingest


def gates(spark, name, version, at):
    row = [("g1", "n", name, "x", "s", "o", "p", at, version)]
    return spark.createDataFrame(row, "gate_id string, native_id string, name string, architecture string, source_id string, source_object_id string, provenance_event_id string, observed_at string, record_version long")


def test_lake_round_trip(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.write("gate", gates(spark, "Earlier", 1, "2026-01-01"), "s", "r1")
    lake.write("gate", gates(spark, "Later", 2, "2026-02-01"), "s", "r2")
    assert lake.history("gate").count() == 2
    assert lake.current("gate").first()["name"] == "Later"
    assert lake.as_of("gate", "2026-01-15").first()["name"] == "Earlier"
    assert lake.verify().isEmpty()
    lake.write("gate", gates(spark, "Later still", 2, "2026-02-01"), "s", "r2")
    assert lake.history("gate").count() == 2
    assert lake.install_views() == ["gate"]
    assert spark.sql("SELECT name FROM gate").first()[0] == "Later still"
    lake.remove("gate", "s", "r2")
    assert lake.current("gate").first()["name"] == "Earlier"
    with pytest.raises(ValueError, match="repeated keys"):
        lake.write("gate", gates(spark, "a", 1, "2026-01-01").union(gates(spark, "b", 1, "2026-01-01")), "s", "r3")
    assert checksums(spark, str(tmp_path / "lake")).count() > 2


def test_changed_and_missing_shards_are_found(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.write("gate", gates(spark, "A", 1, "2026-01-01"), "s", "r1")
    lake.write("gate", gates(spark, "B", 2, "2026-01-02"), "s", "r2")
    folder = tmp_path / "lake" / "gate" / "source_id=s"
    gates(spark, "C", 3, "2026-01-03").drop("source_id").coalesce(1).write.mode("append").parquet(str(folder / "run=r9"))
    assert lake.history("gate").count() == 2
    for shard in (folder / "run=r1").glob("*.parquet"):
        shard.write_bytes(next((folder / "run=r2").glob("*.parquet")).read_bytes())
    for extra in (folder / "run=r1").glob(".*.crc"):
        extra.unlink()
    for shard in (folder / "run=r2").glob("*.parquet"):
        shard.unlink()
    assert sorted((r["run"], r["problem"]) for r in lake.verify().collect()) == [("r1", "changed"), ("r2", "missing"), ("r9", "not in the manifest")]


def test_batches_replay_and_runs_freeze(spark, tmp_path):
    target = str(tmp_path / "stage")
    rows = spark.range(50)
    assert ingest.stage_batch(rows, target, 0) == ingest.stage_batch(rows.repartition(7), target, 0)
    ingest.stage_batch(spark.range(5), target, 1)
    with pytest.raises(ValueError, match="other rows"):
        ingest.stage_batch(spark.range(51), target, 0)
    first = ingest.finish(spark, target, {"a": 1})
    assert (first["batches"], first["rows"]) == (2, 55)
    ingest.stage_batch(spark.range(3), target, 2)
    assert ingest.finish(spark, target, {"a": 1}) == first
    with pytest.raises(ValueError, match="other parameters"):
        ingest.finish(spark, target, {"a": 2})


def test_guard_refuses_other_parameters(spark, tmp_path):
    path = str(tmp_path / "cp")
    assert ingest.guard(spark, path, {"a": 1, "b": 2}) == ingest.guard(spark, path, {"b": 2, "a": 1})
    with pytest.raises(ValueError, match="other parameters"):
        ingest.guard(spark, path, {"a": 2})


def test_streamed_merge_equals_batch(spark, tmp_path):
    schema = "k string, f string, v string, c string, d boolean"
    parts = [[("n", "x", "1", "1", False), ("n", "y", "1", "1", False)], [("n", "x", "2", "2", False), ("m", "x", "9", "1", False)], [("n", "x", "0", "0", False), ("n", "y", None, "3", True)]]
    source = str(tmp_path / "in")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        q = ingest.merge_stream(stream, "k", "f", "v", "c", "d", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    last = found.groupBy("key", "field").agg(F.max_by(F.struct("value", "deleted"), "clock").alias("w"))
    assert {(r["key"], r["field"], r["w"]["value"], r["w"]["deleted"]) for r in last.collect()} == {("n", "x", "2", False), ("n", "y", None, True), ("m", "x", "9", False)}


def test_staged_batches_are_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.json(source)
    for _ in range(2):
        stream = spark.readStream.schema("id long").json(source)
        ingest.staged(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
