"""Every query by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, once."""

    def add(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"two queries are named {name}")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return add


def _all() -> dict[str, Entry]:
    from cairn.plans import entity_queries, evaluation_queries, evidence_queries, map_queries, measure_queries, measure_whole_queries, relation_queries, report_queries, shape_queries, source_queries, spatial_queries, text_queries, time_queries  # noqa: F401

    return _ENTRIES


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in _all().items() if e.sql}
