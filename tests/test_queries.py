"""Registered queries against their DuckDB texts on the smallest tables."""

from __future__ import annotations

import importlib
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.operators import events as E
from tallyforge.plans import bindings, registry

SF = "/root/testdata/sf0.001"


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(con.execute(registry.ORACLES[name]).df())


def test_entry_loads_without_a_session():
    """In a fresh process, before any session: every query and its SQL can be listed."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout) >= len(registry.QUERIES), run.stderr


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_module_of_queries_is_registered():
    """No module that fills a register is left out, and no two of them use one name."""
    folder = Path(registry.__file__).parent
    modules = [importlib.import_module(f"tallyforge.plans.{p.stem}") for p in sorted(folder.glob("*_queries.py"))]
    names = [n for m in modules for n in m.Q.queries]
    assert len(names) == len(set(names)) and set(names) == set(registry.QUERIES)
    assert {n for m in modules for n in m.Q.oracles} == set(registry.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stream_and_batch_suppression_agree(spark):
    batch = {(r["key"], r["at"]): r["accepted"] for r in entry.queries()["rec_05_suppress_repeats"](spark, SF).collect()}
    stream = {(r["key"], r["at"]): r["accepted"] for r in entry.queries()["str_03_suppress_repeats"](spark, SF).collect()}
    assert batch == stream and len(batch) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["acc_02_attribution", "acc_03_rule_exemption", "agg_07_rule_histogram", "agg_04_full_summary"])
def test_attribution_reads_each_input_once(spark, name):
    """Model, final and events: the events' lines once, and the lines' sums behind the three readings of tickets."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["agg_12_segment_state", "jn_01_ticket_state"])
def test_inputs_are_dealt_into_bounded_tasks(spark, name, monkeypatch):
    """Tickets and lines go into as many tasks as their number needs, whatever the settings say; the rows stay the same."""
    few = rows_of(registry.QUERIES[name](spark, SF).toPandas())
    monkeypatch.setattr(bindings, "TASK_LINES", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    dealt = registry.QUERIES[name](spark, SF)
    exchanges = re.findall(r"hashpartitioning\((?:stem|\w_orderkey|num)#\w+, (\d+)\)", dealt._jdf.queryExecution().executedPlan().toString())
    assert exchanges and all(int(n) * 500 >= lines for n in exchanges)
    assert rows_of(dealt.toPandas()) == few and len(few) > 1000


def test_folded_touches_equal_the_long_form(spark):
    """Reviews between stagings, blanks, rules on unchanged columns, a record that is only reviewed, one without a model."""
    rows = [(s, i, who, kind, v, r) for s, log in {
        "a": [("preparer", "review", "9", "X"), ("preparer", "stage", "1", "P"), ("inputter", "review", "7", ""), ("inputter", "stage", "2", " "), ("preparer", "stage", "2", "Q"), (None, "stage", None, "R")],
        "b": [("inputter", "review", "5", "")], "c": [("inputter", "stage", " ", "S")], "d": [("preparer", "stage", "1.0", "P")], "e": [("preparer", "stage", "3", "P")]}.items() for i, (who, kind, v, r) in enumerate(log)]
    log = spark.createDataFrame(rows, "stem string, seq long, role string, kind string, N string, rule_N string")
    model = spark.createDataFrame([("a", "0"), ("b", "1"), ("c", ""), ("d", "1")], "stem string, N string")
    want = E.last_touchers(E.event_diffs(log, model, {"N": "int"}))
    folded = E.folded_touches(log, {"N": "int"}).join(model.withColumnRenamed("N", "m"), "stem", "left")
    got = folded.select("stem", F.lit("N").alias("field"), E.touches("N", "int", F.col("m")).alias("t")).select("stem", "field", "t.*").where("by_inputter or by_preparer")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 2
    assert {r["stem"]: r["reviewed"] for r in folded.where("staged").collect()} == {r["stem"]: r["reviewed"] for r in E.fold_stage_events(log.withColumns({"who": F.lit("u"), "at": F.lit("")}), ["N"]).where("staged").collect()}


def test_records_hold_the_rows_of_both_bindings(spark, tmp_path, monkeypatch):
    """Also for orders that come twice or without lines, parts that are unknown or come twice, and missing values."""
    day = "TIMESTAMP '1998-02-06 00:00:00'"
    tables = {
        "nation": "SELECT 2 AS n_nationkey, 'PERU' AS n_name",
        "customer": "SELECT * FROM VALUES (1L, 'Customer#1', 2), (2L, NULL, 2), (3L, 'Customer#3', 9) AS t(c_custkey, c_name, c_nationkey)",
        "orders": f"SELECT *, 'O' AS o_orderstatus, '5-LOW' AS o_orderpriority, {day} AS o_orderdate FROM VALUES (7L, 1L), (7L, 2L), (8L, 1L), (9L, 2L), (10L, 1L), (11L, 3L), (12L, NULL), (NULL, 1L), (13L, 1L) AS t(o_orderkey, o_custkey)",
        "part": "SELECT * FROM VALUES (3L, 'large ring'), (4L, NULL), (5L, 'small  nut'), (5L, 'small bolt') AS t(p_partkey, p_name)",
        "lineitem": "SELECT * FROM VALUES (7L, 3L, 1, 2.0D), (7L, 5L, 1, 4.0D), (8L, 99L, 1, 1.0D), (9L, 4L, 2, 1.0D), (9L, 3L, NULL, NULL), (11L, 3L, 1, 1.0D), (12L, 3L, 1, 1.0D), (NULL, 3L, 1, 1.0D), (13L, NULL, 1, 5.0D) AS t(l_orderkey, l_partkey, l_linenumber, l_quantity)",
    }
    blank = {"customer": ["c_mktsegment"], "lineitem": []}
    for name in bindings.TABLES:
        rows = spark.sql(tables.get(name, "SELECT 1 AS x"))
        rows.selectExpr("*", *[f"'X' AS {c}" for c in blank.get(name, [])]).write.parquet(f"{tmp_path}/{name}.parquet")
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    records = bindings.print_records(spark, str(tmp_path))
    fields, prints = (bindings.bind(spark, str(tmp_path), n) for n in ("print_fields", "prints"))
    assert as_rows(records.select("stem", F.inline("fields"))) == as_rows(fields.select("stem", "field", "kind", "value"))
    lines = records.select("stem", "num", F.posexplode("texts").alias("i", "text")).select("stem", "num", F.col("i") + 1, "text")
    assert as_rows(lines) == as_rows(prints.select("stem", "num", "i", "text"))
    assert records.where("stem = 'T7'").select(F.size("texts")).first()[0] == 2 * 5 + 2 * 3
    # dealt out into tasks of a bounded number of lines
    monkeypatch.setattr(bindings, "dealt_tasks", lambda spark, sf_dir: 7)
    dealt = bindings.print_records(spark, str(tmp_path))
    assert as_rows(dealt) == as_rows(records) and "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
