"""Incremental ingestion on Structured Streaming: staged batches, guarded checkpoints and stateful merges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def query_hash(parameters: dict) -> str:
    """A digest of a run's parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def guard(spark: SparkSession, checkpoint: str, parameters: dict) -> str:
    """The run's hash; a checkpoint that belongs to other parameters is refused."""
    path, own = f"{checkpoint.rstrip('/')}/_parameters", query_hash(parameters)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        found = spark.read.parquet(path).first()["hash"]
        if found != own:
            raise ValueError("the checkpoint belongs to a run with other parameters")
    else:
        spark.createDataFrame([(own,)], "hash string").coalesce(1).write.parquet(path)
    return own


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of them that their order does not change."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"), F.coalesce(F.bit_xor(row), F.lit(0)).cast("string").alias("x")).first()
    return got["n"], hashlib.sha256(f"{got['n']}|{got['s']}|{got['x']}".encode()).hexdigest()


def stage_batch(batch: DataFrame, target: str, number: int) -> str:
    """Write a batch to its own folder with its fingerprint; a batch that was there with other rows is refused, one with the same rows is left as it is."""
    spark, path = batch.sparkSession, f"{target.rstrip('/')}/batch={number}"
    rows, digest = fingerprint(batch)
    mark = f"{target.rstrip('/')}/_fingerprints/{number}"
    if _exists(spark, mark):
        if spark.read.parquet(mark).first()["digest"] != digest:
            raise ValueError(f"batch {number} was staged with other rows")
        return digest
    batch.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(number, rows, digest)], "batch long, rows long, digest string").coalesce(1).write.mode("overwrite").parquet(mark)
    return digest


def finish(spark: SparkSession, target: str, parameters: dict) -> dict:
    """The manifest of a completed run: made once from its batches' fingerprints, and from then on returned as it is stored. Other parameters are refused."""
    path, own = f"{target.rstrip('/')}/_manifest", query_hash(parameters)
    if not _exists(spark, path):
        marks = spark.read.parquet(f"{target.rstrip('/')}/_fingerprints/*")
        one = marks.agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("batch", "digest")))), 256).alias("digest"))
        one.withColumn("query_hash", F.lit(own)).coalesce(1).write.parquet(path)
    found = spark.read.parquet(path).first().asDict()
    if found["query_hash"] != own:
        raise ValueError("the completed run had other parameters")
    return found


def staged(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write each batch to its own folder under the target; a batch that runs again replaces itself, so nothing is written twice."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(edits: DataFrame, key: str, field: str, value: str, clock: str, deleted: str, out: str, checkpoint: str) -> StreamingQuery:
    """Field-level last-write-wins over a stream of edits: state holds each key's fields with their clocks.

    Emits the key's fields that changed. Late and repeated edits change nothing that a greater
    clock has written, so the order of arrival does not matter.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        changed = set()
        for part in rows:
            for f, v, c, d in zip(part["field"], part["value"], part["clock"], part["deleted"], strict=True):
                if f not in held or [c, v or ""] > [held[f][0], held[f][1] or ""]:
                    held[f] = [c, v, bool(d)]
                    changed.add(f)
        state.update((json.dumps(held, sort_keys=True),))
        names = sorted(changed)
        yield pd.DataFrame({"key": [k[0]] * len(names), "field": names, "value": [held[f][1] for f in names], "clock": [held[f][0] for f in names], "deleted": [held[f][2] for f in names]})

    base = edits.select(F.col(key).cast("string").alias("key"), F.col(field).alias("field"), F.col(value).cast("string").alias("value"), F.col(clock).cast("string").alias("clock"), F.col(deleted).alias("deleted"))
    merged = base.groupBy("key").applyInPandasWithState(update, "key string, field string, value string, clock string, deleted boolean", "state string", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return merged.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_deltas(batches: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Sum over batches of what each found, by coverage key."""
    return batches.groupBy(*keys).agg(F.sum(F.col(after) - F.col(before)).alias("found"))
