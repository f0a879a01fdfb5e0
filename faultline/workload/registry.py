"""The list of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from faultline.session import apply_settings

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    operators: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}

# Base columns the SQL starts from; it never looks at rendered text.
EVENTS_SQL = """
WITH ev AS (
  SELECT event_id, user_id, event_type, value, ts, date_trunc('second', ts) AS sec,
         'app-' || (user_id % 20) || '.log' AS file
  FROM events
)
"""


def query(name: str, operators: str, sql: str | None = None, with_events: bool = True):
    """Register a query; ``operators`` are the survey ids it exercises."""
    def register(run: Run) -> Run:
        @wraps(run)
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)
            return run(spark, folder)

        text = sql
        if text is not None and with_events:
            tail = text.strip()
            text = EVENTS_SQL.strip() + (", " + tail[5:] if tail.startswith("WITH ") else "\n" + tail)
        QUERIES[name] = Query(name, prepared, tuple(operators.split()), text)
        return run

    return register
