"""One query for each operator of the library, over tables derived from the star schema, with the SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklight.sources.standin import AS_OF, Library, oracle

NOW = dt.datetime.fromisoformat(AS_OF)
T = f"TIMESTAMP '{AS_OF}'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the library; sql is the same in the other engine's dialect, over the derived tables."""

    def add(f: Callable[[Library], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, folder: f(Library(spark, folder))
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def placed(order: str, rows: str = "tracks", where: str = "true", columns: str = "track_id", limit: int | None = None) -> str:
    """SQL for an ordered list with positions from 0."""
    inner = f"select *, row_number() over (order by {order}) - 1 as position from {rows} where {where}"
    return f"select position, {columns} from ({inner}) z" + (f" where position < {limit}" if limit is not None else "")


def load() -> None:
    from tracklight.queries import analyst, history, library, lists, matching, rules  # noqa: F401


load()
