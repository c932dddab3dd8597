"""Registered queries and their DuckDB equivalents, one key per inventory row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import accuracy_queries, event_queries, evidence_queries, ledger_queries, record_queries, report_queries, rule_queries, scalar_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (scalar_queries, record_queries, event_queries, evidence_queries, ledger_queries, accuracy_queries, report_queries, rule_queries):
    QUERIES |= module.Q.queries
    ORACLES |= module.Q.oracles
