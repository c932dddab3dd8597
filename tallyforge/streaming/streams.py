"""Structured Streaming variants (STR-*): each takes a streaming DataFrame; ``drain`` runs one to the end of its input."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.operators.events import fold_stage_events


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, one of our own, but only if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ingest(spark: SparkSession, folder: str, table: str, schema: StructType | None = None) -> DataFrame:
    """STR-01: new files of a table as a stream, each read once (the checkpoint remembers them)."""
    schema = schema or spark.read.parquet(f"{folder}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 100)
    # a glob matches both a single file and a folder of files
    return rows.parquet(f"{folder}/{table}.parquet*")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the present input and return what came out as a table."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def drain_latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Run a stream in update mode; of each key the row with the largest ``order`` stays."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{place}/rows")).start().awaitTermination()
    rest = [c for c in stream.columns if c != key]
    rows = spark.read.schema(stream.schema).parquet(f"{place}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def dedup(stream: DataFrame, *keys: str, time: str = "ts", late: str = "60 days") -> DataFrame:
    """STR-02: the first row of each key; keys older than the watermark are forgotten."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def _new_log(spark: SparkSession, target: str) -> None:
    """The log of finished batches, a row each; it is made once and outlives the stream."""
    spark.createDataFrame([(-1,)], "batch long").coalesce(1).write.mode("ignore").parquet(f"{target}/log")


def _finished(spark: SparkSession, target: str, before: int = 1 << 62) -> list[int]:
    rows = spark.read.schema("batch long").parquet(f"{target}/log").where((F.col("batch") >= 0) & (F.col("batch") < before)).distinct().collect()
    return sorted(r["batch"] for r in rows)


def _finish(spark: SparkSession, target: str, n: int) -> None:
    """Said last, so that a batch that broke off is none; a batch that is run again is said twice, which changes nothing."""
    spark.createDataFrame([(n,)], "batch long").coalesce(1).write.mode("append").parquet(f"{target}/log")


def _suppress(ttl: int):
    """The fold over sorted rows (key, kind, at, fp, ok): a key's memory (kind 0) comes first, its events after it; what it
    remembers in the end comes out as ``is_state``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory, out = None, None, []

        def given() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = {"key": pa.string(), "at": pa.int64(), "fp": pa.string(), "accepted": pa.bool_(), "is_state": pa.bool_()}
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for key, kind, at, fp, ok in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (key,) != now:
                    if memory:
                        out.append((now[0], memory[1], memory[0], None, True))
                    now, memory = (key,), None
                if kind == 0:
                    memory = (fp, at)
                    continue
                repeat = memory is not None and fp == memory[0] and at - memory[1] < ttl
                if not repeat:
                    memory = (fp, at) if ok and fp is not None else None
                out.append((key, at, fp, not repeat, False))
            yield given()
        if memory:
            out.append((now[0], memory[1], memory[0], None, True))
            yield given()

    return run


def suppress_repeats(stream: DataFrame, ttl: int, target: str | None = None) -> DataFrame:
    """STR-03: as the batch fold: a write equal to the last accepted one within ``ttl`` is suppressed; a failure clears the memory.

    ``key, at, fp, ok`` in; ``key, at, fp, accepted`` out, of all batches that ``target`` holds: a stream that is started again
    with the same ``target`` goes on where it ended. Each batch is sorted within partitions, behind one remembered row per
    key, and folded row by row, so a task holds one key's memory whatever the key's history. What is ``ttl`` older than
    a batch's oldest write is forgotten: neither it nor a later one could repeat it.
    """
    spark = stream.sparkSession
    target = target or f"{shared_folder(spark)}/suppress-{uuid.uuid4().hex}"
    schema = "key string, at long, fp string, accepted boolean, is_state boolean"
    _new_log(spark, target)

    def merge(df: DataFrame, n: int) -> None:
        rows = df.select("key", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), "fp", "ok")
        if before := _finished(spark, target, n):
            last = spark.read.schema(schema).parquet(f"{target}/batch-{before[-1]}").where("is_state")
            rows = rows.unionByName(last.select("key", F.lit(0).alias("kind"), "at", "fp", F.lit(True).alias("ok")))
        oldest = F.broadcast(rows.agg(F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("_oldest")))
        rows = rows.join(oldest).where((F.col("kind") == 1) | (F.col("at") > F.col("_oldest") - ttl)).drop("_oldest")
        dealt = rows.repartition("key").sortWithinPartitions("key", "kind", "at", "fp", "ok")
        dealt.mapInArrow(_suppress(ttl), schema).write.mode("overwrite").parquet(f"{target}/batch-{n}")
        _finish(spark, target, n)

    stream.writeStream.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    paths = [f"{target}/batch-{n}" for n in _finished(spark, target)]
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return found.where("NOT is_state").select("key", "at", "fp", "accepted")


def fold(stream: DataFrame, columns: list[str]) -> DataFrame:
    """STR-04: the batch fold of staging events (EVT-03) as a stateful aggregate, in update mode: one state row per record."""
    return fold_stage_events(stream, columns)


def usage_by_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """STR-05: events and amounts per day, by a tumbling window with a watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    days = timed.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("amount"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "amount")


def upsert_stream(stream: DataFrame, key: str, order: str, buckets: int = 32, target: str | None = None) -> DataFrame:
    """STR-07: last write wins per key, batch by batch; ``target`` holds the table and outlives the stream.

    Keys are dealt into buckets; a batch rewrites only the buckets it touches, as a version of its own. A small table per
    batch says which version each bucket has, so a batch that is run again, or a number that is skipped, changes nothing.
    """
    spark = stream.sparkSession
    target = target or f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rest = [c for c in stream.columns if c != key]
    _new_log(spark, target)

    def versions(before: int) -> dict[int, int]:
        known = _finished(spark, target, before)
        if not known:
            return {}
        return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{target}/versions-{known[-1]}").collect()}

    def merge(df: DataFrame, n: int) -> None:
        rows = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").parquet(f"{target}/batch-{n}")
        rows = spark.read.schema(rows.schema).parquet(f"{target}/batch-{n}")
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        if not touched:
            return
        now = versions(n)
        for b in touched:
            if b in now:
                rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{target}/rows-{now[b]}/_bucket={b}").withColumn("_bucket", F.lit(b)))
        merged = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), order).alias("r")).select("_bucket", key, "r.*")
        merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/rows-{n}")
        spark.createDataFrame(list({**now, **dict.fromkeys(touched, n)}.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions-{n}")
        _finish(spark, target, n)

    stream.writeStream.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    paths = [f"{target}/rows-{n}/_bucket={b}" for b, n in versions(1 << 62).items()]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def failures(stream: DataFrame, most: int = 3) -> DataFrame:
    """STR-08: ``name, failures, given_up, last`` for attempts (``name, scan, ok``): failures since the file's last success.

    The state of a file is its last success and the failures after it; within a batch only numbers of failed attempts are kept.
    """

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        count, last_ok, last = state.get if state.exists else (0, -1, -1)
        failed, best = [], last_ok
        for batch in batches:
            ok, scan = batch["ok"].to_numpy() == 1, batch["scan"].to_numpy()
            best = max(best, int(scan[ok].max(initial=-1)))
            last = max(last, int(scan.max(initial=-1)))
            failed.append(scan[~ok])
        count = (count if best == last_ok else 0) + int((np.concatenate(failed) > best).sum())
        state.update((count, best, last))
        yield pd.DataFrame({"name": [key[0]], "failures": [count], "given_up": [count >= most], "last": [last]})

    return stream.groupBy("name").applyInPandasWithState(step, "name string, failures long, given_up boolean, last long", "failures long, last_ok long, last long", "update", "NoTimeout")
