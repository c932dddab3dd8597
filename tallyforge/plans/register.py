"""A list of queries over bindings, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.bindings import bind, bind_dealt, prelude, print_records


class Register:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, inputs: list[str], of: Callable[..., DataFrame], sql: str | None = None, dealt: tuple[str, ...] = ()) -> None:
        """``of`` gets one DataFrame for each input binding; ``sql`` reads them by name. Inputs of ``dealt`` are dealt out by ``stem``
        to tasks of a bounded number of records."""
        self.queries[name] = lambda spark, sf_dir: of(*(bind_dealt(spark, sf_dir, inputs, dealt) if dealt else [bind(spark, sf_dir, n) for n in inputs]))
        self._text(name, inputs, sql)

    def add_records(self, name: str, inputs: list[str], of: Callable[..., DataFrame], sql: str) -> None:
        """As ``add``, but ``of`` gets ``print_records`` first, for the inputs ``prints`` and ``print_fields``, then the others."""
        others = [n for n in inputs if n not in ("prints", "print_fields")]
        self.queries[name] = lambda spark, sf_dir: of(print_records(spark, sf_dir), *[bind(spark, sf_dir, n) for n in others])
        self._text(name, inputs, sql)

    def _text(self, name: str, inputs: list[str], sql: str | None) -> None:
        if sql:
            self.oracles[name] = (prelude(*inputs) if inputs else "") + sql
