"""Audit records: shaping, queries and statistics."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import moment
from faultline.functions.text import text_map
from faultline.schema import AUDIT

QUERY_LIMIT = 100
RECENT_HOURS = 24
RECENT_LIMIT = 50
PREVIEW_CHARS = 500
DETAIL_CHARS = 40


def newest_first(entries: DataFrame) -> list[Column]:
    """Sort order of audit views. Entries of the same time keep their order of writing, which is
    ``seq`` where the table has it and else the id."""
    return [F.desc("timestamp"), F.asc("seq" if "seq" in entries.columns else "id")]


def filter_audit(
    entries: DataFrame,
    start: datetime | Column | None = None,
    end: datetime | Column | None = None,
    action: str | None = None,
    result: str | None = None,
    host: str | None = None,
) -> DataFrame:
    """Entries that meet all given conditions; both time bounds are inclusive.

    Entries stored by day have a ``date``; the bounds then limit it too, so that only the days
    between them are read.
    """
    def bound(time: datetime | Column) -> Column:
        return moment(time) if isinstance(time, datetime) else time

    timestamp = F.col("timestamp")
    by_day = "date" in entries.columns
    if start is not None:
        entries = entries.filter(timestamp >= bound(start))
        if by_day:
            entries = entries.filter(F.col("date") >= F.to_date(bound(start)))
    if end is not None:
        entries = entries.filter(timestamp <= bound(end))
        if by_day:
            entries = entries.filter(F.col("date") <= F.to_date(bound(end)))
    for name, value in (("action", action), ("result", result), ("host", host)):
        if value:
            entries = entries.filter(F.col(name) == value)
    return entries


def query_audit(
    entries: DataFrame,
    start: datetime | Column | None = None,
    end: datetime | Column | None = None,
    action: str | None = None,
    result: str | None = None,
    host: str | None = None,
    limit: int | None = QUERY_LIMIT,
) -> DataFrame:
    """Matching entries, newest first. With a limit each task keeps only its own newest ones."""
    found = filter_audit(entries, start, end, action, result, host)
    found = found.orderBy(*newest_first(found))
    return found if limit is None else found.limit(limit)


def recent_audit(
    entries: DataFrame,
    as_of: datetime,
    hours: int = RECENT_HOURS,
    action: str | None = None,
    limit: int = RECENT_LIMIT,
) -> DataFrame:
    """The view of the last hours: time, action, result, host and a short detail."""
    found = query_audit(entries, start=as_of - timedelta(hours=hours), action=action, limit=limit)
    known = F.when(F.col("command") != "", F.col("command"))
    log_file = F.when(
        F.map_contains_key("details", "log_file"), F.element_at("details", F.lit("log_file"))
    ).otherwise("-")
    return found.select(
        F.date_format("timestamp", "MM-dd HH:mm:ss").alias("time"),
        "action", "result",
        F.coalesce(F.when(F.col("host") != "", F.col("host")), F.lit("-")).alias("host"),
        F.substring(F.coalesce(known, log_file), 1, DETAIL_CHARS).alias("detail"),
    )


def audit_entry(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(F.col("id") == entry_id)


def audit_statistics(entries: DataFrame) -> DataFrame:
    """``dimension, value, count`` with dimensions total, action, result and host.

    One pass over the entries counts all combinations first; the dimensions are then folded from
    those few rows. Entries without a host are not counted by host.
    """
    host = F.when(F.col("host") != "", F.col("host"))
    combined = entries.groupBy("action", "result", host.alias("host")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), value.alias("value"))
            for name, value in (
                ("total", F.lit(None).cast("string")), ("action", F.col("action")),
                ("result", F.col("result")), ("host", F.col("host")),
            )
        ]
    )
    return (
        combined.select("n", F.explode(cells).alias("_cell"))
        .select("n", "_cell.dimension", "_cell.value")
        .filter((F.col("dimension") == "total") | F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("count"))
    )


def _shaped(events: DataFrame, action: str, columns: Mapping[str, Column]) -> DataFrame:
    """AUDIT rows. Columns the event has under the same name are taken over."""
    values: dict[str, Column] = {}
    for field in AUDIT.fields:
        if field.name in columns:
            value = columns[field.name]
        elif field.name == "action":
            value = F.lit(action)
        elif field.name in events.columns:
            value = F.col(field.name)
        elif field.name == "id":
            value = F.uuid()
        elif field.name == "timestamp":
            value = F.current_timestamp()
        elif field.name == "duration_ms":
            value = F.lit(0)
        else:
            value = F.lit(None)
        values[field.name] = value.cast(field.dataType).alias(field.name)
    return events.select(*values.values())


def _optional(events: DataFrame, name: str, chars: int | None = None) -> Column:
    """A detail that is left out when it is absent or empty."""
    if name not in events.columns:
        return F.lit(None).cast("string")
    value = F.when(F.col(name) != "", F.col(name).cast("string"))
    return value if chars is None else F.substring(value, 1, chars)


def command_events(events: DataFrame) -> DataFrame:
    """Audit rows of commands run: ``host, command, result, exit_code`` and output previews."""
    code = F.col("exit_code") if "exit_code" in events.columns else F.lit(0)
    details = text_map({
        "exit_code": F.coalesce(code, F.lit(0)).cast("string"),
        "stdout_preview": _optional(events, "stdout_preview", PREVIEW_CHARS),
        "stderr_preview": _optional(events, "stderr_preview", PREVIEW_CHARS),
    })
    return _shaped(events, "command_execute", {"details": details})


def ssh_connect_events(events: DataFrame) -> DataFrame:
    """Audit rows of connections: ``host, result, username, port``."""
    port = F.col("port") if "port" in events.columns else F.lit(22)
    columns = {"details": text_map({"port": F.coalesce(port, F.lit(22)).cast("string")})}
    if "username" in events.columns:
        columns["user"] = F.col("username")
    return _shaped(events, "ssh_connect", columns)


def analyze_events(events: DataFrame) -> DataFrame:
    """Audit rows of analyses: ``log_file, result, problem_type``."""
    details = text_map({
        "log_file": F.col("log_file"),
        "problem_type": _optional(events, "problem_type"),
    })
    return _shaped(events, "log_analyze", {"details": details})


def agent_action_events(events: DataFrame) -> DataFrame:
    """Audit rows of session steps: ``round, action_type, result, host, command`` and ``extra``, a
    map whose entries win over the standard details."""
    details = text_map({
        "round": F.col("round").cast("string"), "action_type": F.col("action_type"),
    })
    if "extra" in events.columns:
        extra = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(details, lambda k, v: ~F.map_contains_key(extra, k))
        details = F.map_concat(kept, extra)
    return _shaped(events, "agent_action", {"details": details})
