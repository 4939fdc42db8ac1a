"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated query under its own name, with its SQL counterpart."""

    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    from cairn.functions import chunking, erasure, scalars  # noqa: F401
    from cairn.operators import aggregates, coverage, dedup, intervals, ordered, planning, predicates, scans, timeline  # noqa: F401  they register their queries
    from cairn.sources import archives  # noqa: F401
    from cairn.streaming import stateful  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _ALL.items() if s}
