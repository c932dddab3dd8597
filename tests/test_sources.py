"""Reading record files and keyed sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.functions import text as T
from tallyforge.operators import events as E
from tallyforge.operators import ledger as G
from tallyforge.operators import reconcile as R
from tallyforge.sources import records as X
from tallyforge.streaming import streams as ST


def test_read_records_skips_snapshots_and_keeps_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"MAWB_NO": "1"}))
    (tmp_path / "all_x.json").write_text(json.dumps({"MAWB_NO": "2"}))
    (tmp_path / "b.json").write_text("{broken")
    rows = X.read_records(spark, str(tmp_path), StructType([StructField("MAWB_NO", StringType())])).collect()
    assert sorted((r["stem"], r["MAWB_NO"]) for r in rows) == [("a", "1"), ("b", None)]


def test_list_inputs(spark, tmp_path):
    for n in ("a.PDF", "~$a.pdf", "b.txt"):
        (tmp_path / n).write_text("x")
    assert [r["name"] for r in X.list_inputs(spark, str(tmp_path), ["pdf"]).collect()] == ["a.PDF"]


def test_upsert_rejects_bad_rows(spark):
    target = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    source = spark.createDataFrame([("b", "3"), ("c", ""), ("d", "4")], "k string, v string")
    merged, rejects = X.upsert(target, source, "k", ~T.blank(F.col("v")))
    assert sorted(map(tuple, merged.collect())) == [("a", "1"), ("b", "3"), ("d", "4")]
    assert [r["k"] for r in rejects.collect()] == ["c"]


def test_compact(spark, tmp_path):
    X.compact(spark.range(10).repartition(5), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_transcripts_of_mixed_lines(spark):
    raw = [
        (1, '```json\n{"lines": ["a", {"text": "b", "bbox": [1, 2, 3, 4], "page": 2}, "", {"text": ""}, {"bbox": [1]}, 5, {"text": 7, "bbox": [1, 2]}, {"text": " c", "bbox": "x"}]}\n```'),
        (2, '{"lines": []}'), (3, "no json"), (4, None), (5, '{"other": 1}'),
    ]
    got = {r["k"]: [tuple(x) for x in r["l"]] for r in spark.createDataFrame(raw, "k int, raw string").select("k", X.normalise_lines(F.col("raw")).alias("l")).collect()}
    assert got == {1: [(1, "a", None, None), (2, "b", [1.0, 2.0, 3.0, 4.0], 2), (3, "5", None, None), (4, "7", None, None), (5, " c", None, None)], 2: [], 3: [], 4: [], 5: []}


def test_recheck_keeps_history_and_is_idempotent(spark):
    records = spark.createDataFrame([("a",), ("b",)], "stem string")
    flags = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "w")], "stem string, message string")
    evidence = spark.createDataFrame([("a", 3, 2, "F")], "stem string, checked long, passed long, failed string")
    old = spark.createDataFrame([("a", "2026-09-01", " "), ("z", "2026-09-02", "m")], "stem string, processed_at string, model string")
    once = X.recheck(records, flags, evidence, old, ["processed_at", "model"])
    twice = X.recheck(records, flags, evidence, once, ["processed_at", "model"])
    rows = {r["stem"]: r for r in once.collect()}
    assert rows["a"]["flags"] == ["w", "x", "evidence: F"] and rows["a"]["processed_at"] == "2026-09-01" and rows["a"]["model"] is None
    assert rows["b"]["flags"] == ["no transcript"] and rows["b"]["needs_review"] and rows == {r["stem"]: r for r in twice.collect()}


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """A hot key over several batches, and a stream that is started again, give what the batch fold gives."""
    rows = [("hot" if i % 3 else f"k{i % 11}", i, str(i // 70 % 4), i % 13 != 0) for i in range(6000)]
    schema = "key string, at long, fp string, ok boolean"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:2500], rows[2500:4000]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ST.suppress_repeats(stream(), 90, target)
    spark.createDataFrame(rows[4000:], schema).coalesce(1).write.mode("append").parquet(folder)
    got = ST.suppress_repeats(stream(), 90, target).collect()
    want = E.suppress_repeats(spark.createDataFrame(rows, schema), 90).collect()
    assert len(got) == 6000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    spread = str(tmp_path / "upsert")
    ST.upsert_stream(stream(), "key", "at", 4, spread)
    spark.createDataFrame([("hot", 9000, "last", True)], schema).coalesce(1).write.mode("append").parquet(folder)
    last = {r["key"]: r["at"] for r in ST.upsert_stream(stream(), "key", "at", 4, spread).collect()}
    assert last["hot"] == 9000 and len(last) == 12 and last["k3"] == max(at for k, at, _, _ in rows if k == "k3")


def test_a_purge_goes_on_after_any_step(spark, tmp_path):
    """Stopped before each of its steps in turn, a purge ends as one that was never stopped, and purges what it set out to."""
    rows = [(f"k{i}", i) for i in range(20)]
    tables = lambda: [(n, spark.createDataFrame(rows, "stem string, v int")) for n in ("derived", "source", "ledger")]
    items = spark.createDataFrame([("k1", 40), ("k2", 3), ("k3", None)], "stem string, idle int")

    class Stop(Exception):
        pass

    for at in ("tombstones", "derived", "source", "ledger"):
        target = str(tmp_path / at)

        def stop(step, at=at):
            if step == at:
                raise Stop

        with pytest.raises(Stop):
            R.purge_run(tables(), items, "stem", 30, target, stop)
        ran = []
        # by now the plan is another one; it only counts if the tombstones were not written
        R.purge_run(tables(), items if at == "tombstones" else items.limit(0), "stem", 30, target, ran.append)
        assert ran == ["tombstones", "derived", "source", "ledger"][["tombstones", "derived", "source", "ledger"].index(at):]
        assert {tuple(r) for r in spark.read.parquet(f"{target}/tombstones").select("stem", "early").collect()} == {("k1", False), ("k2", True), ("k3", True)}
        for name in ("derived", "source", "ledger"):
            assert {r["stem"] for r in spark.read.parquet(f"{target}/{name}").collect()} == {k for k, _ in rows} - {"k1", "k2", "k3"}


def test_records_of_one_partition_are_written_by_all_cores(spark, tmp_path):
    rows = spark.range(40).coalesce(1).select(F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("value"))
    X.write_records(rows, str(tmp_path / "r"))
    names = [p.name for p in (tmp_path / "r").glob("part-*.txt")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1


def test_ledger_modes_agree_with_the_filter_of_each(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "2026", None), ("c", None, 0)], "stem string, submitted_at string, flags int")
    modes = ["unsent", "flag", "done", "other"]
    got = {(r["mode"], r["stem"]) for r in G.ledger_modes(rows, modes).collect()}
    assert got == {(m, r["stem"]) for m in modes for r in G.ledger_filter(rows, m).collect()}
