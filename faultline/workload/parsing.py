"""Queries over parsers and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import extract_timestamp
from faultline.functions.levels import normalize_level
from faultline.operators.custom import CustomFormat, ParserConfig
from faultline.operators.detect import detect_custom, detect_formats, report_format_label
from faultline.operators.dmesg import Dmesg
from faultline.operators.haproxy import HAProxy
from faultline.operators.lineformat import parse_as
from faultline.operators.multiline import event_lines, multiline_lines
from faultline.operators.nginx import Nginx
from faultline.operators.parse import parse_logs, parse_mixed
from faultline.operators.syslog import Syslog
from faultline.operators.templates import TEMPLATES, builtin_format, list_templates
from faultline.workload import render
from faultline.workload.registry import query
from faultline.workload.render import by_type, lines, text


def _ntz(name: str = "ts"):
    return F.col(name).cast("timestamp_ntz").alias(name)


STATUS_SQL = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"
HTTP_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
METHOD_SQL = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END"
ADDRESS_SQL = "'10.1.' || ((user_id >> 8) % 256) || '.' || (user_id % 256)"
MESSAGE_SQL = (
    "CASE event_type WHEN 'error' THEN 'request failed' WHEN 'signup' THEN 'Warning: slow'"
    " WHEN 'purchase' THEN 'CRITICAL state' WHEN 'view' THEN 'debug dump' ELSE 'all good' END"
    " || ' #' || event_id"
)
MESSAGE_LEVEL_SQL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'"
    " WHEN 'purchase' THEN 'FATAL' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
)


@query("nginx_access", "P1 P12", f"""
SELECT file, event_id AS line_id, sec - INTERVAL 8 HOUR AS ts, {HTTP_LEVEL_SQL} AS level,
       {METHOD_SQL} || ' /u/' || user_id || ' - ' || {STATUS_SQL} AS message,
       {ADDRESS_SQL} AS ip_address, {METHOD_SQL} AS request_method,
       '/u/' || user_id AS request_url, CAST({STATUS_SQL} AS INTEGER) AS status_code,
       event_id AS size
FROM ev
""")
def nginx_access(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.nginx_access()), Nginx()).entries
    return entries.select(
        "file", "line_id", _ntz(), "level", "message", "ip_address", "request_method",
        "request_url", "status_code", "size",
    )


@query("nginx_error", "P2 P11", """
SELECT file, event_id AS line_id, sec AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'FATAL'
            WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
       strftime(sec, '%M:%S') || ' [' ||
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'crit'
            WHEN 'purchase' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'notice' END ||
       '] ' || user_id || '#0: event ' || event_id AS message
FROM ev
""")
def nginx_error(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.nginx_error()), Nginx()).entries
    return entries.select("file", "line_id", _ntz(), "level", "message")


@query("haproxy_entries", "P3", f"""
SELECT file, event_id AS line_id, sec AS ts, {HTTP_LEVEL_SQL} AS level,
       'back' || (user_id % 3) || ' -> srv' || (user_id % 4) || ': ' || {STATUS_SQL} AS message,
       {ADDRESS_SQL} AS ip_address, CAST({STATUS_SQL} AS INTEGER) AS status_code,
       'back' || (user_id % 3) AS backend_name, 'srv' || (user_id % 4) AS server_name
FROM ev
""")
def haproxy_entries(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.haproxy()), HAProxy()).entries
    return entries.select(
        "file", "line_id", _ntz(), "level", "message", "ip_address", "status_code",
        "backend_name", "server_name",
    )


@query("haproxy_backends", "P3", f"""
SELECT 'back' || (user_id % 3) AS backend_name, CAST({STATUS_SQL} AS INTEGER) AS status_code,
       count(*) AS n
FROM ev GROUP BY 1, 2
""")
def haproxy_backends(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.haproxy()), HAProxy()).entries
    return entries.groupBy("backend_name", "status_code").agg(F.count(F.lit(1)).alias("n"))


@query("syslog_rfc3164", "P4 P9", f"""
SELECT file, event_id AS line_id,
       make_timestamp(1900, month(sec), day(sec), hour(sec), minute(sec), second(sec)) AS ts,
       {MESSAGE_LEVEL_SQL} AS level, {MESSAGE_SQL} AS message, 'host' || (user_id % 7) AS host,
       'app[' || user_id || ']' AS process
FROM ev
""")
def syslog_rfc3164(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.syslog_3164()), Syslog()).entries
    return entries.select("file", "line_id", _ntz(), "level", "message", "host", "process")


@query("syslog_rfc5424", "P5 P9", f"""
SELECT file, event_id AS line_id, sec AS ts, {MESSAGE_LEVEL_SQL} AS level,
       {MESSAGE_SQL} AS message, 'host' || (user_id % 7) AS host, 'app' AS process
FROM ev
""")
def syslog_rfc5424(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.syslog_5424()), Syslog()).entries
    return entries.select("file", "line_id", _ntz(), "level", "message", "host", "process")


@query("syslog_rfc5424_native", "P5", """
SELECT event_id AS line_id, sec - INTERVAL 2 HOUR + INTERVAL 250 MILLISECOND AS ts FROM ev
""")
def syslog_rfc5424_native(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.syslog_5424()), Syslog(compat=False)).entries
    return entries.select("line_id", _ntz())


@query("dmesg_entries", "P6 P7 P10", """
SELECT event_id AS line_id,
       CASE event_type WHEN 'signup' THEN sec END AS ts, event_type <> 'signup' AS ts_imputed,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'ERROR'
            WHEN 'click' THEN 'FATAL' ELSE 'INFO' END AS level,
       CASE event_type WHEN 'error' THEN 'link failed' WHEN 'signup' THEN 'usb 1-1: new device'
            WHEN 'purchase' THEN 'disk quota'
            WHEN 'view' THEN '[note] tcp: dev eth1: reset by 10.9.8.7 ok'
            ELSE 'kernel panic soon' END AS message,
       CASE event_type WHEN 'error' THEN 'eth0' ELSE 'kernel' END AS process,
       CASE event_type WHEN 'error' THEN 'eth0' END AS subsystem,
       event_type IN ('error', 'view') AS network_related,
       CASE event_type WHEN 'view' THEN 'eth1' END AS device,
       CASE event_type WHEN 'view' THEN '10.9.8.7' END AS dev_ip,
       CASE WHEN event_type <> 'signup' THEN event_id + 0.25 END::DOUBLE AS uptime
FROM ev
""")
def dmesg_entries(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    entries = parse_as(lines(ev, render.dmesg()), Dmesg()).entries
    return entries.select(
        "line_id", _ntz(), "ts_imputed", "level", "message", "process", "subsystem",
        "network_related", "device", "dev_ip", "uptime",
    )


@query("quarantined_lines", "P1 P20", """
SELECT CASE event_type WHEN 'click' THEN 'bad_timestamp' ELSE 'no_match' END AS reason,
       count(*) AS n
FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1
""")
def quarantined_lines(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    kind = F.col("event_type")
    value = (
        F.when(kind == "view", text("noise ", F.col("event_id")))
        .when(kind == "click", F.regexp_replace(render.nginx_access(), r"\[[^:]+:", "[31/Feb/2024:"))
        .when(kind == "signup", F.lit(" \t "))
        .otherwise(render.nginx_access())
    )
    quarantine = parse_as(lines(ev, value), Nginx()).quarantine
    return quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("clock_shapes", "P12", """
SELECT event_id,
       CASE event_type
         WHEN 'error' THEN sec - INTERVAL 8 HOUR
         WHEN 'purchase' THEN make_timestamp(1900, month(sec), day(sec), hour(sec), minute(sec),
                                             second(sec))
         WHEN 'click' THEN NULL
         ELSE sec END AS ts
FROM ev
""")
def clock_shapes(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    kind = F.col("event_type")
    shown = (
        F.when(kind == "error", text(render.clf_time(), " +0800"))
        .when(kind == "signup", F.date_format("sec", "yyyy-MM-dd HH:mm:ss.'123'"))
        .when(kind == "purchase", F.date_format("sec", "MMM d HH:mm:ss"))
        .when(kind == "view", render.clf_time())
        .otherwise(F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return ev.select("event_id", extract_timestamp(shown).cast("timestamp_ntz").alias("ts"))


@query("normalized_levels", "P11", """
SELECT CASE event_type WHEN 'error' THEN 'FATAL' WHEN 'signup' THEN 'WARN'
            WHEN 'purchase' THEN 'DEBUG' WHEN 'view' THEN 'ERROR' ELSE 'INFO' END AS level,
       count(*) AS n
FROM ev GROUP BY 1
""")
def normalized_levels(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    word = by_type(
        error="Critical", signup="WARNING", purchase="debug", view="Err", click="emerg"
    )
    return ev.groupBy(normalize_level(word).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def _template(ev: DataFrame, name: str, value, compat: bool = True) -> DataFrame:
    return parse_as(lines(ev, value), builtin_format(name, compat)).entries


@query("apache_access", "P8 P13", f"""
SELECT event_id AS line_id, sec - INTERVAL 8 HOUR AS ts, 'INFO' AS level, {METHOD_SQL} AS message,
       {ADDRESS_SQL} AS ip_address, {METHOD_SQL} AS request_method, '/u/' || user_id AS request_url,
       CAST({STATUS_SQL} AS VARCHAR) AS status_code, CAST(event_id AS VARCHAR) AS response_size
FROM ev
""")
def apache_access(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    names = ("ip_address", "request_method", "request_url", "status_code", "response_size")
    return _template(ev, "apache_access", render.nginx_access()).select(
        "line_id", _ntz(), "level", "message",
        *[F.element_at("fields", F.lit(n)).alias(n) for n in names],
    )


@query("apache_error", "P8 P14", """
SELECT event_id AS line_id, sec + INTERVAL 500 MILLISECOND AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'FATAL'
            WHEN 'purchase' THEN 'FATAL' WHEN 'view' THEN 'INFO' ELSE 'DEBUG' END AS level,
       'event ' || event_id AS message
FROM ev
""")
def apache_error(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    word = by_type(error="error", signup="emerg", purchase="crit", view="notice", click="debug")
    client = F.when(F.col("event_type") == "error", "[client 10.0.0.1] ").otherwise("")
    value = text(
        "[", F.date_format("sec", "EEE MMM dd HH:mm:ss"), ".500 ", F.date_format("sec", "yyyy"),
        "] [", word, "] ", client, "event ", F.col("event_id"),
    )
    return _template(ev, "apache_error", value).select("line_id", _ntz(), "level", "message")


_JSON_MESSAGE = (
    "'{\"time\":\"' || strftime(sec, '%Y-%m-%dT%H:%M:%S') || '\",\"level\":\"' || event_type ||"
    " '\",\"message\":\"event ' || event_id || '\"}'"
)


def _json_line():
    return text(
        '{"time":"', F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss"), '","level":"',
        F.col("event_type"), '","message":"event ', F.col("event_id"), '"}',
    )


@query("json_log", "P8 P15", f"""
SELECT event_id AS line_id, NULL::TIMESTAMP AS ts, true AS ts_imputed, 'INFO' AS level,
       {_JSON_MESSAGE} AS message
FROM ev
""")
def json_log(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return _template(ev, "json_log", _json_line()).select(
        "line_id", _ntz(), "ts_imputed", "level", "message"
    )


@query("json_log_native", "P15", """
SELECT event_id AS line_id, sec AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       'event ' || event_id AS message
FROM ev
""")
def json_log_native(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return _template(ev, "json_log", _json_line(), compat=False).select(
        "line_id", _ntz(), "level", "message"
    )


@query("csv_log", "P8 P16", """
SELECT event_id AS line_id, sec AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       'user ' || user_id || ', event ' || event_id AS message
FROM ev
""")
def csv_log(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    value = text(
        F.date_format("sec", "yyyy-MM-dd HH:mm:ss"), ",", F.col("event_type"), ",user ",
        F.col("user_id"), ", event ", F.col("event_id"),
    )
    return _template(ev, "csv_log", value).select("line_id", _ntz(), "level", "message")


def _generic(ev: DataFrame):
    mark = F.when(F.col("event_type") == "view", "'T'").otherwise("' '")
    day, clock = F.date_format("sec", "yyyy-MM-dd"), F.date_format("sec", "HH:mm:ss")
    return text(
        day, F.when(mark == "'T'", "T").otherwise(" "), clock, " ", F.col("event_type"), ": event ",
        F.col("event_id"),
    )


_GENERIC_SQL = """
SELECT event_id AS line_id, {ts} AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       'event ' || event_id AS message
FROM ev
"""


@query("generic_log", "P8 P17", _GENERIC_SQL.format(ts="CASE WHEN event_type <> 'view' THEN sec END"))
def generic_log(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return _template(ev, "generic_log", _generic(ev)).select("line_id", _ntz(), "level", "message")


@query("generic_log_native", "P17", _GENERIC_SQL.format(ts="sec"))
def generic_log_native(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return _template(ev, "generic_log", _generic(ev), compat=False).select(
        "line_id", _ntz(), "level", "message"
    )


CUSTOM = ParserConfig.from_dict({
    "name": "shop",
    "pattern": r"<(?P<when>[^>]+)> (\w+) id=(\d+|-) ok=(\w+)(?: amount=(\S+))? (.*)",
    "timestamp_format": "%d.%m.%y %I:%M:%S %p",
    "timestamp_group": 1,
    "level_group": 2,
    "message_group": 6,
    "level_mapping": {"PURCHASE": "AUDIT", "ERROR": "FATAL"},
    "field_mappings": [
        {"name": "id", "pattern_group": 3, "transform": "int", "default": -1},
        {"name": "ok", "pattern_group": 4, "transform": "bool"},
        {"name": "amount", "pattern_group": 5, "transform": "float"},
        {"name": "last"},
        {"name": "absent", "pattern_group": 9, "default": "none"},
    ],
})


@query("custom_format", "P8 S9", """
SELECT event_id AS line_id, sec AS ts,
       CASE event_type WHEN 'purchase' THEN 'AUDIT' WHEN 'error' THEN 'FATAL' ELSE 'INFO' END
         AS level,
       'done ' || event_id AS message,
       CASE event_type WHEN 'click' THEN '-1' ELSE CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_type IN ('view', 'click') THEN 'true' ELSE 'false' END AS ok,
       event_type = 'purchase' AS has_amount,
       'done ' || event_id AS last, 'none' AS absent
FROM ev
""")
def custom_format(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    kind = F.col("event_type")
    value = text(
        "<", F.date_format("sec", "dd.MM.yy hh:mm:ss a"), "> ", kind, " id=",
        F.when(kind == "click", "-").otherwise(F.col("event_id").cast("string")), " ok=",
        by_type(error="no", signup="0", purchase="off", view="Yes", click="on"),
        F.when(kind == "purchase", text(" amount=", F.col("value"))).otherwise(""),
        " done ", F.col("event_id"),
    )
    entries = parse_as(lines(ev, value), CustomFormat(CUSTOM)).entries
    fields = F.col("fields")
    return entries.select(
        "line_id", _ntz(), "level", "message", fields["id"].alias("id"), fields["ok"].alias("ok"),
        F.map_contains_key(fields, "amount").alias("has_amount"), fields["last"].alias("last"),
        fields["absent"].alias("absent"),
    )


# Four more formats, each with another clock.
SHOP_FORMATS = [CUSTOM, *[ParserConfig.from_dict(data) for data in (
    {"name": "faults", "pattern": r"(\S+ \S+) \[(\w+)\] (.*)", "level_group": 2, "message_group": 3},
    {"name": "members", "pattern": r"(\w+);([^;]+);(.*)", "timestamp_format": "%d/%m/%Y %H:%M:%S",
     "timestamp_group": 2, "level_group": 1, "message_group": 3},
    {"name": "visits", "pattern": r"(\d{8}T\d{6}) seen (\d+)", "timestamp_format": "%Y%m%dT%H%M%S",
     "field_mappings": [{"name": "id", "pattern_group": 2, "transform": "int"}]},
    {"name": "taps", "pattern": r"tap (\S+) at ([\d: -]+)", "timestamp_group": 2, "message_group": 1,
     "detect_patterns": [r"^tap \S+ at "]},
)]]


@query("configured_formats", "P8 S9 D3 P20", """
SELECT event_type || '.log' AS file, event_id AS line_id, sec AS ts,
       CASE event_type WHEN 'purchase' THEN 'shop' WHEN 'error' THEN 'faults' WHEN 'signup' THEN 'members'
         WHEN 'view' THEN 'visits' ELSE 'taps' END AS format,
       CASE event_type WHEN 'purchase' THEN 'AUDIT' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END
         AS level,
       CASE event_type WHEN 'purchase' THEN 'done ' WHEN 'error' THEN 'down ' WHEN 'signup' THEN 'new ' ELSE '' END
         || event_id AS message,
       CASE WHEN event_type IN ('purchase', 'view') THEN CAST(event_id AS VARCHAR) END AS id
FROM ev
""")
def configured_formats(spark, folder) -> DataFrame:
    """Files of five configured formats, detected together and parsed in one scan."""
    ev = render.events(spark, folder)
    kind, number = F.col("event_type"), F.col("event_id")
    iso = F.date_format("sec", "yyyy-MM-dd HH:mm:ss")
    value = (
        F.when(kind == "purchase", text(
            "<", F.date_format("sec", "dd.MM.yy hh:mm:ss a"), "> purchase id=", number, " ok=off done ", number))
        .when(kind == "error", text(iso, " [error] down ", number))
        .when(kind == "signup", text("warn;", F.date_format("sec", "dd/MM/yyyy HH:mm:ss"), ";new ", number))
        .when(kind == "view", text(F.date_format("sec", "yyyyMMdd'T'HHmmss"), " seen ", number))
        .otherwise(text("tap ", number, " at ", iso))
    )
    shown = ev.select(text(kind, ".log").alias("file"), "line_id", value.alias("value"))
    entries = parse_logs(shown, configs=SHOP_FORMATS).entries
    return entries.select(
        "file", "line_id", _ntz(), "format", "level", "message", F.col("fields")["id"].alias("id")
    )


@query("template_detection", "D3 P18", """
SELECT template, kind || '.log' AS file,
       CASE template
         WHEN 'apache_access' THEN kind = 'error'
         WHEN 'apache_error' THEN kind = 'signup'
         WHEN 'json_log' THEN kind = 'purchase'
         WHEN 'csv_log' THEN kind IN ('view', 'purchase')
         ELSE kind = 'click' END AS detected
FROM (SELECT DISTINCT event_type AS kind FROM ev) k,
     (SELECT unnest(['apache_access', 'apache_error', 'json_log', 'csv_log', 'generic_log'])
        AS template) t
""")
def template_detection(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    kind = F.col("event_type")
    iso = F.date_format("sec", "yyyy-MM-dd HH:mm:ss")
    value = (
        F.when(kind == "error", render.nginx_access())
        .when(kind == "signup", text(
            "[", F.date_format("sec", "EEE MMM dd HH:mm:ss yyyy"), "] [warn] slow"))
        .when(kind == "purchase", _json_line())
        .when(kind == "view", text("t", iso, ",info,seen"))
        .otherwise(text(iso, " info: seen"))
    )
    shown = ev.select(text(kind, ".log").alias("file"), "line_id", value.alias("value"))
    found = None
    for name, data in TEMPLATES.items():
        one = detect_custom(shown, ParserConfig.from_dict(data)).select(
            F.lit(name).alias("template"), "file", "detected"
        )
        found = one if found is None else found.unionByName(one)
    return found.join(F.broadcast(list_templates(spark).select("template")), "template")


def _rendered_mix(ev: DataFrame) -> DataFrame:
    """Five files, each in another format."""
    which = F.col("user_id") % 5
    value = (
        F.when(which == 0, render.nginx_access())
        .when(which == 1, render.haproxy())
        .when(which == 2, render.syslog_3164())
        .when(which == 3, render.dmesg())
        .otherwise(text("plain words ", F.col("event_id")))
    )
    return ev.select(text("mix-", which, ".log").alias("file"), "line_id", value.alias("value"))


_FORMAT_SQL = (
    "CASE user_id % 5 WHEN 0 THEN 'nginx' WHEN 1 THEN 'haproxy' WHEN 2 THEN 'syslog'"
    " WHEN 3 THEN 'dmesg' ELSE 'unknown' END"
)


@query("detect_formats", "D1 D2 D4", f"""
SELECT DISTINCT 'mix-' || (user_id % 5) || '.log' AS file, {_FORMAT_SQL} AS format FROM ev
""")
def detected_formats(spark, folder) -> DataFrame:
    return detect_formats(_rendered_mix(render.events(spark, folder)))


@query("mixed_parse", "P20 D4", f"""
SELECT 'mix-' || (user_id % 5) || '.log' AS file, {_FORMAT_SQL} AS format,
       CASE WHEN user_id % 5 IN (0, 1) THEN {HTTP_LEVEL_SQL}
            WHEN user_id % 5 = 2 THEN {MESSAGE_LEVEL_SQL}
            ELSE CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'ERROR'
                                 WHEN 'click' THEN 'FATAL' ELSE 'INFO' END END AS level,
       count(*) AS n, min(event_id) AS first_line
FROM ev WHERE user_id % 5 <> 4 GROUP BY 1, 2, 3
""")
def mixed_parse(spark, folder) -> DataFrame:
    entries = parse_logs(_rendered_mix(render.events(spark, folder)), files=5).entries
    return entries.groupBy("file", "format", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")
    )


@query("mixed_quarantine", "P20", """
SELECT 'mix-4.log' AS file, 'unknown_format' AS reason, count(*) AS n
FROM ev WHERE user_id % 5 = 4
""")
def mixed_quarantine(spark, folder) -> DataFrame:
    quarantine = parse_logs(_rendered_mix(render.events(spark, folder)), files=5).quarantine
    return quarantine.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("report_labels", "D5", """
SELECT DISTINCT 'mix-' || (user_id % 5) || '.log' AS file,
       CASE WHEN user_id % 5 IN (0, 1) THEN 'Nginx' ELSE 'Syslog' END AS file_format
FROM ev WHERE user_id % 5 <> 4
""")
def report_labels(spark, folder) -> DataFrame:
    mix = _rendered_mix(render.events(spark, folder))
    name = F.col("file")
    known = mix.withColumn(
        "format",
        F.when(name == "mix-0.log", "nginx").when(name == "mix-1.log", "haproxy")
        .when(name == "mix-2.log", "syslog").when(name == "mix-3.log", "dmesg"),
    )
    return report_format_label(parse_mixed(known).entries)


def _physical_lines(ev: DataFrame) -> DataFrame:
    """Three lines per event; only the first one looks like a log line."""
    rendered = F.array(
        text(F.date_format("sec", "yyyy-MM-dd HH:mm:ss"), ",", F.col("event_type"), ",event ",
             F.col("event_id")),
        text("  at user ", F.col("user_id")),
        text("  at value ", F.col("event_id") * 2),
    )
    return ev.select(
        "file", F.col("event_id").alias("_event"), F.posexplode(rendered).alias("_i", "value")
    ).select("file", (F.col("_event") * 3 + F.col("_i")).alias("line_id"), "value")


#: A file in which everything but the first event's head belongs to that event.
LONG = "long.log"


def _multiline_files(spark, folder) -> DataFrame:
    """The usual files, and one whose only event has three lines for each event of the table."""
    ev = render.events(spark, folder)
    first = ev.agg(F.min("event_id")).head()[0]
    line_id = F.col("event_id") * 3 + F.col("_i")
    long = ev.select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("_i")).select(
        F.lit(LONG).alias("file"), line_id.alias("line_id"),
        F.when(line_id == F.lit(first) * 3, "2024-01-01 00:00:00,error,all of them")
        .otherwise(text("  then ", line_id)).alias("value"),
    )
    return _physical_lines(ev).unionByName(long)


@query("multiline_events", "P19", f"""
SELECT file, event_no, i AS line_no, event_id * 3 + i AS line_id,
       CASE i WHEN 0 THEN strftime(sec, '%Y-%m-%d %H:%M:%S') || ',' || event_type || ',event ' || event_id
         WHEN 1 THEN '  at user ' || user_id ELSE '  at value ' || (event_id * 2) END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS event_no FROM ev),
     (SELECT unnest([0, 1, 2])::BIGINT AS i)
UNION ALL
SELECT '{LONG}', 1, row_number() OVER (ORDER BY event_id, i) - 1, event_id * 3 + i,
       CASE WHEN event_id * 3 + i = 3 * min(event_id) OVER () THEN '2024-01-01 00:00:00,error,all of them'
         ELSE '  then ' || (event_id * 3 + i) END
FROM ev, (SELECT unnest([0, 1, 2])::BIGINT AS i)
""")
def multiline_events(spark, folder) -> DataFrame:
    return event_lines(_multiline_files(spark, folder), r"\d{4}-\d{2}-\d{2} ")


MULTILINE_CSV = ParserConfig.from_dict(
    {**TEMPLATES["csv_log"], "multiline": True, "multiline_pattern": r"\d{4}-"}
)


@query("multiline_entries", "P19 P16", f"""
SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n,
       min(sec) AS ts_min, (count(*) * 3)::BIGINT AS lines, 0::BIGINT AS quarantined
FROM ev GROUP BY 1
UNION ALL
SELECT '{LONG}', 1, TIMESTAMP '2024-01-01 00:00:00', 3 * count(*), 0 FROM ev
""")
def multiline_entries(spark, folder) -> DataFrame:
    """Entries of the heads, with the lines of their events and those that could not be read."""
    heads = multiline_lines(_multiline_files(spark, folder), MULTILINE_CSV)
    parsed = parse_as(heads, CustomFormat(MULTILINE_CSV))
    name = F.when(F.col("file") == LONG, LONG).otherwise(F.col("level"))
    read = parsed.entries.select("file", "line_id", name.alias("level"), "ts", F.lit(0).alias("_bad"))
    bad = parsed.quarantine.select(
        "file", "line_id", F.lit("quarantine").alias("level"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(1).alias("_bad"),
    )
    sizes = heads.select("file", "line_id", "lines")
    return read.unionByName(bad).join(sizes, ["file", "line_id"]).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("ts_min"),
        F.sum("lines").alias("lines"), F.sum("_bad").alias("quarantined"),
    )
