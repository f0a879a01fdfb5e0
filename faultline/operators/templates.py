"""Ready-made custom formats."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.levels import normalize_level
from faultline.functions.text import captures, matched
from faultline.operators.custom import CustomFormat, ParserConfig
from faultline.operators.lineformat import NO_MATCH, LineFormat

# The formats every installation knows
TEMPLATES: dict[str, dict[str, Any]] = {
    "apache_access": {
        "name": "Apache Access Log",
        "description": "Apache HTTP Server access log format",
        "pattern": r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) ([^"]+) HTTP/[^"]+" (\d+) (\d+)',
        "timestamp_format": "%d/%b/%Y:%H:%M:%S %z",
        "timestamp_group": 2,
        "message_group": 3,
        "field_mappings": [
            {"name": "ip_address", "pattern_group": 1},
            {"name": "request_method", "pattern_group": 3},
            {"name": "request_url", "pattern_group": 4},
            {"name": "status_code", "pattern_group": 5, "transform": "int"},
            {"name": "response_size", "pattern_group": 6, "transform": "int"},
        ],
        "detect_patterns": [r'^\d+\.\d+\.\d+\.\d+.*\] "[A-Z]+ .*HTTP'],
    },
    "apache_error": {
        "name": "Apache Error Log",
        "description": "Apache HTTP Server error log format",
        "pattern": r"^\[([^\]]+)\] \[(\w+)\] (\[client [^\]]+\] )?(.+)$",
        "timestamp_format": "%a %b %d %H:%M:%S.%f %Y",
        "timestamp_group": 1,
        "level_group": 2,
        "message_group": 4,
        "level_mapping": {
            "EMERG": "FATAL",
            "ALERT": "FATAL",
            "CRIT": "FATAL",
            "ERROR": "ERROR",
            "WARN": "WARN",
            "NOTICE": "INFO",
            "INFO": "INFO",
            "DEBUG": "DEBUG",
        },
        "detect_patterns": [r"^\[[A-Za-z]{3} [A-Za-z]{3} \d+.*\] \[\w+\]"],
    },
    "json_log": {
        "name": "JSON Log",
        "description": "JSON format log (one JSON object per line)",
        "pattern": r"^(\{.*\})$",
        "timestamp_format": "%Y-%m-%dT%H:%M:%S",
        "timestamp_group": 1,
        "message_group": 1,
        "detect_patterns": [r'^\{.*"[tT]ime"'],
    },
    "csv_log": {
        "name": "CSV Log",
        "description": "CSV format log",
        "pattern": r"^([^,]+),([^,]+),(.*)$",
        "timestamp_format": "%Y-%m-%d %H:%M:%S",
        "timestamp_group": 1,
        "level_group": 2,
        "message_group": 3,
    },
    "generic_log": {
        "name": "Generic Log",
        "description": "Generic log with timestamp and level",
        "pattern": (
            r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\s*(\w+)?\s*[:\-\]]?\s*(.+)$"
        ),
        "timestamp_format": "%Y-%m-%d %H:%M:%S",
        "timestamp_group": 1,
        "level_group": 2,
        "message_group": 3,
    },
}


class JsonLines(LineFormat):
    """One JSON object per line with its members decoded: what ``json_log`` is in native mode."""

    name = "JSON Log"

    def __init__(
        self, time: str = "time", level: str = "level", message: str = "message"
    ):
        self.keys = (time, level, message)

    def first(self, line: Column) -> Column:
        return captures(line, r"^(\{.*\})$", ["$1", ""])

    def second(self, line: Column, first: Column) -> Column:
        members = F.from_json(line, ", ".join(f"`{k}` string" for k in self.keys))
        return F.when(matched(first), members)

    def timestamp(self, first: Column, second: Column | None) -> Column:
        return second.getField(self.keys[0]).try_cast("timestamp")

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        level, message = (second.getField(k) for k in self.keys[1:])
        return {
            "reason": F.when(~matched(first), NO_MATCH),
            "ts_imputed": F.col("_ts").isNull(),
            "level": F.coalesce(normalize_level(level), F.lit("INFO")),
            "message": F.coalesce(message, F.lit("")),
            "fields": F.create_map().cast("map<string,string>"),
        }


def builtin_format(template: str, compat: bool = True) -> LineFormat | None:
    """The format of a template, or None for an unknown name.

    Without ``compat``, ``json_log`` decodes its members and ``generic_log`` also reads times
    with a ``T``.
    """
    if template not in TEMPLATES:
        return None
    data = dict(TEMPLATES[template])
    if not compat and template == "json_log":
        return JsonLines()
    if not compat and template == "generic_log":
        data["more_timestamp_formats"] = ["%Y-%m-%dT%H:%M:%S"]
    return CustomFormat(ParserConfig.from_dict(data))


def list_templates(spark: SparkSession) -> DataFrame:
    """Template keys with their names and descriptions, in registry order."""
    rows = [
        (i, key, data["name"], data["description"])
        for i, (key, data) in enumerate(TEMPLATES.items())
    ]
    return spark.createDataFrame(
        rows, "position int, template string, name string, description string"
    )
