"""Schemas and closed value sets shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampType()
TEXT_MAP = T.MapType(S, S)
TEXTS = T.ArrayType(S)

#: One physical line. ``line_id`` is unique and increasing within ``file``.
LINE = _struct(("file", S), ("line_id", L), ("value", S))

LOG_ENTRY = _struct(
    ("file", S), ("line_id", L), ("format", S), ("ts", TS), ("ts_imputed", B), ("level", S),
    ("message", S), ("raw", S), ("fields", TEXT_MAP), ("ip_address", S), ("request_method", S),
    ("request_url", S), ("status_code", I), ("backend_name", S), ("server_name", S),
    ("process", S), ("pid", I), ("size", L), ("host", S), ("uptime", D), ("subsystem", S),
    ("network_related", B), ("device", S), ("dev_ip", S),
)

COMMAND = _struct(("category", S), ("description", S), ("command", S))

ANALYSIS = _struct(
    ("problem_type", S), ("possible_causes", TEXTS), ("risk_level", S),
    ("suggested_commands", T.ArrayType(COMMAND)), ("confidence", D),
)

POLICY = _struct(
    ("command", S), ("description", S), ("category", S), ("allowed_args", TEXTS),
    ("risk_level", S), ("requires_sudo", B), ("allowed_patterns", TEXTS),
)

AUDIT = _struct(
    ("id", S), ("timestamp", TS), ("action", S), ("result", S), ("host", S), ("command", S),
    ("error_message", S), ("duration_ms", L), ("user", S), ("source_ip", S),
    ("details", TEXT_MAP),
)

RESULTS = _struct(
    ("session_id", S), ("command_idx", L), ("host_idx", I), ("command", S), ("host", S),
    ("exit_code", I), ("stdout", S), ("stderr", S), ("duration", D), ("ts", TS),
)

#: One step that a session took.
ACTION = _struct(
    ("id", S), ("type", S), ("description", S), ("parameters", TEXT_MAP), ("result", S),
    ("success", B), ("error", S), ("timestamp", TS),
)

MEMORY = _struct(
    ("session_id", S), ("id", L), ("timestamp", TS), ("round", I), ("action_type", S),
    ("action_description", S), ("observation", S), ("result_summary", S), ("metadata", TEXT_MAP),
)

# Fixed values
LEVELS = ("INFO", "WARN", "ERROR", "FATAL", "DEBUG")

AUDIT_ACTIONS = (
    "ssh_connect", "ssh_disconnect", "command_execute", "command_batch", "log_analyze",
    "report_generate", "agent_diagnose", "agent_action", "whitelist_check", "plan_create",
    "plan_execute",
)
# Result values; a diagnosis in progress is logged as "started".
AUDIT_RESULTS = ("success", "failure", "timeout", "cancelled")

ACTION_TYPES = ("analyze", "execute", "observe", "decide", "report", "ask")
AGENT_STATUSES = ("idle", "thinking", "executing", "observing", "completed", "failed")
