"""Queries over log statistics, model requests and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import moment
from faultline.functions.formatting import format_duration, format_size, risk_label
from faultline.operators.lineformat import parse_as
from faultline.operators.nginx import Nginx
from faultline.operators.prompt import OPENING, REQUEST, prompt_context
from faultline.operators.stats import (
    error_sample, grouped_entries, level_counts, level_shares, log_statistics, top_error_types,
    totals,
)
from faultline.operators.syslog import Syslog
from faultline.plans.report import FOOTER, markdown_reports
from faultline.workload import render
from faultline.workload.parsing import (
    HTTP_LEVEL_SQL, MESSAGE_LEVEL_SQL, MESSAGE_SQL, METHOD_SQL, STATUS_SQL,
)
from faultline.workload.registry import query
from faultline.workload.render import lines

AS_OF = datetime(2024, 2, 1, 12, 0, 0)


def _access(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return parse_as(lines(ev, render.nginx_access()), Nginx()).entries


def _syslog(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    return parse_as(lines(ev, render.syslog_3164()), Syslog(assume_year=2024)).entries


_ENTRIES = f"""
WITH entry AS (
  SELECT file, event_id, sec - INTERVAL 8 HOUR AS ts, {HTTP_LEVEL_SQL} AS level,
         {METHOD_SQL} || ' /u/' || user_id || ' - ' || {STATUS_SQL} AS message
  FROM ev
)
"""
_LEVELS = _ENTRIES.rstrip() + """,
lv AS (SELECT file, level, count(*) AS n, min(event_id) AS first_line FROM entry GROUP BY 1, 2),
tot AS (
  SELECT file, count(*) AS total_lines, count(*) FILTER (level = 'ERROR') AS error_lines,
         count(*) FILTER (level = 'WARN') AS warning_lines, min(ts) AS ts_min, max(ts) AS ts_max
  FROM entry GROUP BY 1
),
typ AS (
  SELECT file, error_type, n,
         row_number() OVER (PARTITION BY file ORDER BY n DESC, first_line) AS rank
  FROM (SELECT file, message[:50] AS error_type, count(*) AS n, min(event_id) AS first_line
        FROM entry WHERE level = 'ERROR' GROUP BY 1, 2)
)
"""
_RATE = "CAST(printf('%.2f', error_lines / total_lines::DOUBLE * 100) AS DOUBLE)"


@query("level_counts", "G1", _LEVELS + "SELECT file, level, n, first_line FROM lv")
def level_counts_(spark, folder) -> DataFrame:
    return level_counts(grouped_entries(_access(spark, folder))).select(
        "file", "level", F.col("count").alias("n"), "first_line"
    )


@query("error_rate", "G2", _LEVELS + f"""
SELECT file, total_lines, error_lines, warning_lines, {_RATE} AS error_rate FROM tot
""")
def error_rate(spark, folder) -> DataFrame:
    return totals(level_counts(grouped_entries(_access(spark, folder)))).select(
        "file", "total_lines", "error_lines", "warning_lines", "error_rate"
    )


@query("time_range", "G3", _LEVELS + "SELECT file, ts_min, ts_max FROM tot")
def time_range(spark, folder) -> DataFrame:
    return totals(level_counts(grouped_entries(_access(spark, folder)))).select(
        "file", F.col("ts_min").cast("timestamp_ntz").alias("ts_min"),
        F.col("ts_max").cast("timestamp_ntz").alias("ts_max"),
    )


@query("top_error_types", "G4", _LEVELS + """
SELECT file, rank, error_type, n FROM typ WHERE rank <= 10
""")
def top_error_types_(spark, folder) -> DataFrame:
    return top_error_types(grouped_entries(_access(spark, folder))).select(
        "file", F.col("rank").cast("bigint").alias("rank"), "error_type",
        F.col("count").alias("n"),
    )


@query("top_error_types_unique", "G4", f"""
SELECT file, message[:50] AS error_type, 1::BIGINT AS n FROM (
  SELECT file, {MESSAGE_SQL} AS message,
         row_number() OVER (PARTITION BY file ORDER BY event_id) AS rank
  FROM ev WHERE event_type = 'error'
) WHERE rank <= 10
""")
def top_error_types_unique(spark, folder) -> DataFrame:
    """Every error text occurs once, so all of them tie."""
    return top_error_types(grouped_entries(_syslog(spark, folder))).select(
        "file", "error_type", F.col("count").alias("n")
    )


@query("log_statistics", "G5 G1 G2 G3 G4", _LEVELS + f"""
SELECT tot.file AS source, total_lines, error_lines, warning_lines, {_RATE} AS error_rate,
       (SELECT string_agg(level || '=' || n, ',' ORDER BY first_line) FROM lv
         WHERE lv.file = tot.file) AS levels,
       coalesce((SELECT string_agg(error_type || '=' || n, ';' ORDER BY rank) FROM typ
         WHERE typ.file = tot.file AND rank <= 10), '') AS types, ts_min, ts_max
FROM tot
""")
def log_statistics_(spark, folder) -> DataFrame:
    def shown(items, name: str, count: str, between: str):
        return F.array_join(
            F.transform(items, lambda x: F.concat(x[name], F.lit("="), x[count].cast("string"))),
            between,
        )

    return log_statistics(_access(spark, folder)).select(
        "source", "total_lines", "error_lines", "warning_lines", "error_rate",
        shown(F.map_entries("level_counts"), "key", "value", ",").alias("levels"),
        shown(F.col("error_types"), "error_type", "count", ";").alias("types"),
        F.col("ts_min").cast("timestamp_ntz").alias("ts_min"),
        F.col("ts_max").cast("timestamp_ntz").alias("ts_max"),
    )


@query("level_bars", "G6", _LEVELS + """
SELECT file AS source, level, n, printf('%.1f', n / total_lines::DOUBLE * 100) || '%' AS percentage,
       repeat('█', CAST(floor(n / total_lines::DOUBLE * 100 / 5) AS INTEGER)) AS bar
FROM lv JOIN tot USING (file)
""")
def level_bars(spark, folder) -> DataFrame:
    return level_shares(log_statistics(_access(spark, folder))).select(
        "source", "level", F.col("count").alias("n"), "percentage", "bar"
    )


@query("error_sample", "G7", f"""
SELECT file, n, sec AS ts, message FROM (
  SELECT file, sec, {MESSAGE_SQL} AS message,
         row_number() OVER (PARTITION BY file ORDER BY event_id) AS n
  FROM ev WHERE {MESSAGE_LEVEL_SQL} IN ('ERROR', 'FATAL')
) WHERE n <= 100
""")
def error_sample_(spark, folder) -> DataFrame:
    return error_sample(_syslog(spark, folder)).select(
        "file", F.col("n").cast("bigint").alias("n"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), "message",
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("prompt_context", "I1", _LEVELS.rstrip() + f""",
err AS (
  SELECT file, '[' || {_TIME.format('ts')} || '] ' || message AS line,
         row_number() OVER (PARTITION BY file ORDER BY event_id) AS n
  FROM entry WHERE level IN ('ERROR', 'FATAL')
)
SELECT tot.file AS source, {_sql_text(OPENING)} ||
       '- 总行数: ' || total_lines || chr(10) || '- 错误行数: ' || error_lines || chr(10) ||
       '- 警告行数: ' || warning_lines || chr(10) || '- 错误率: ' || {_RATE} || '%' || chr(10) ||
       '- 时间范围: ' || {_TIME.format('ts_min')} || ' - ' || {_TIME.format('ts_max')} || chr(10) ||
       chr(10) || '## 日志级别分布' || chr(10) ||
       (SELECT string_agg('- ' || level || ': ' || n || chr(10), '' ORDER BY first_line) FROM lv
         WHERE lv.file = tot.file) ||
       chr(10) || '## 错误类型（Top 10）' || chr(10) ||
       coalesce((SELECT string_agg('- ' || error_type || ': ' || n || '次' || chr(10), ''
                                   ORDER BY rank)
                 FROM typ WHERE typ.file = tot.file AND rank <= 10), '') ||
       chr(10) || '## 错误日志（最近100条）' || chr(10) ||
       coalesce((SELECT string_agg(line || chr(10), '' ORDER BY n) FROM err
                 WHERE err.file = tot.file AND n <= 100), '') || {_sql_text(REQUEST)} AS prompt
FROM tot
""")
def prompt_context_(spark, folder) -> DataFrame:
    entries = _access(spark, folder)
    return prompt_context(log_statistics(entries), entries)


def analyses(stats: DataFrame) -> DataFrame:
    """An analysis per source, derived from its counts."""
    risk = F.when(F.col("error_lines") % 3 == 0, "P0").when(
        F.col("error_lines") % 3 == 1, "P1"
    ).otherwise("P2")

    def command(category: str, description: str, shell: str):
        return F.struct(
            F.lit(category).alias("category"), F.lit(description).alias("description"),
            F.lit(shell).alias("command"),
        )

    commands = F.array(
        command("网络", "连通性", "ping -c 3 h"), command("端口", "监听", "ss -tulpn"),
        command("网络", "路由", "traceroute -n h"),
    )
    return stats.select(
        "source",
        F.when(F.col("warning_lines") % 2 == 0, "连接超时").otherwise("服务异常").alias(
            "problem_type"
        ),
        F.array(F.lit("防火墙限制"), F.lit("服务未启动")).alias("possible_causes"),
        risk.alias("risk_level"),
        F.when(F.col("total_lines") % 2 == 0, commands).otherwise(F.slice(commands, 1, 0)).alias(
            "suggested_commands"
        ),
        F.lit(0.95).alias("confidence"),
    )


_DURATION = """
CASE WHEN s < 60 THEN printf('%.1f', s) || '秒' WHEN s < 3600 THEN printf('%.1f', s / 60) || '分钟'
     ELSE printf('%.1f', s / 3600) || '小时' END
"""


@query("markdown_report", "R1 R2 R3 R4 G6 C8", _LEVELS + f"""
SELECT file AS source, '# 网络诊断报告' || chr(10) || chr(10) ||
  '**生成时间**: 2024-02-01 12:00:00' || chr(10) || chr(10) ||
  '## 📄 文件信息' || chr(10) || chr(10) || '- **文件名**: `' || file || '`' || chr(10) ||
  '- **文件大小**: ' || CASE WHEN total_lines * 100 < 1024
     THEN printf('%.1f', total_lines * 100.0::DOUBLE) || ' B'
     WHEN total_lines * 100 < 1048576 THEN printf('%.1f', total_lines * 100 / 1024.0::DOUBLE) || ' KB'
     ELSE printf('%.1f', total_lines * 100 / 1048576.0::DOUBLE) || ' MB' END || chr(10) ||
  '- **日志格式**: Nginx' || chr(10) || '- **分析时间**: 2024-02-01 12:00:00' || chr(10) || chr(10) ||
  '## 📊 日志概览' || chr(10) || chr(10) ||
  '- **总日志行数**: ' || format('{{:,}}', total_lines) || chr(10) ||
  '- **错误行数**: ' || format('{{:,}}', error_lines) || chr(10) ||
  '- **警告行数**: ' || format('{{:,}}', warning_lines) || chr(10) ||
  '- **错误率**: ' || {_RATE} || '%' || chr(10) || chr(10) || '### 日志级别分布' || chr(10) || chr(10) ||
  (SELECT string_agg('- **' || level || '**: ' || format('{{:,}}', n) || ' (' ||
      printf('%.1f', n / total_lines::DOUBLE * 100) || '%) ' ||
      repeat('█', CAST(floor(n / total_lines::DOUBLE * 100 / 5) AS INTEGER)), chr(10)
      ORDER BY first_line) FROM lv WHERE lv.file = tot.file) || chr(10) || chr(10) ||
  '### 时间范围' || chr(10) || chr(10) || '- **开始**: ' || {_TIME.format('ts_min')} || chr(10) ||
  '- **结束**: ' || {_TIME.format('ts_max')} || chr(10) || '- **时长**: ' ||
  (SELECT {_DURATION} FROM (SELECT date_diff('second', ts_min, ts_max)::DOUBLE AS s)) || chr(10) ||
  chr(10) || '### 错误类型（Top 10）' || chr(10) || chr(10) ||
  coalesce((SELECT string_agg(rank || '. `' || error_type || '` - ' || n || '次', chr(10)
     ORDER BY rank) FROM typ WHERE typ.file = tot.file AND rank <= 10), '无错误日志') || chr(10) ||
  chr(10) || '## 🤖 AI分析结果' || chr(10) || chr(10) || '### 问题类型' || chr(10) || chr(10) || '**' ||
  CASE warning_lines % 2 WHEN 0 THEN '连接超时' ELSE '服务异常' END || '**' || chr(10) || chr(10) ||
  '### 可能原因' || chr(10) || chr(10) || '1. 防火墙限制' || chr(10) || '2. 服务未启动' || chr(10) ||
  chr(10) || '### 风险等级' || chr(10) || chr(10) ||
  CASE error_lines % 3 WHEN 0 THEN '🔴 **P0** - 服务完全不可用'
     WHEN 1 THEN '🟡 **P1** - 部分功能受影响' ELSE '🟢 **P2** - 偶发问题' END || chr(10) || chr(10) ||
  '### 置信度' || chr(10) || chr(10) || '**95.0%**' || chr(10) || chr(10) ||
  '## 🔧 建议的排查命令' || chr(10) || chr(10) ||
  CASE total_lines % 2 WHEN 0 THEN
    chr(10) || '### 网络' || chr(10) || chr(10) || '#### 连通性' || chr(10) || chr(10) || '```bash' ||
    chr(10) || 'ping -c 3 h' || chr(10) || '```' || chr(10) || chr(10) || '#### 路由' || chr(10) ||
    chr(10) || '```bash' || chr(10) || 'traceroute -n h' || chr(10) || '```' || chr(10) || chr(10) ||
    chr(10) || '### 端口' || chr(10) || chr(10) || '#### 监听' || chr(10) || chr(10) || '```bash' ||
    chr(10) || 'ss -tulpn' || chr(10) || '```' || chr(10)
  ELSE '无建议命令' END || chr(10) || chr(10) || '## 📝 下一步' || chr(10) || chr(10) ||
  '1. 执行上述命令收集更多信息' || chr(10) || '2. 根据结果调整排查方向' || chr(10) ||
  '3. 如需进一步分析，可提供更多日志' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  {_sql_text(FOOTER)} || chr(10) AS report
FROM tot
""")
def markdown_report(spark, folder) -> DataFrame:
    stats = log_statistics(_access(spark, folder))
    sizes = stats.select("source", (F.col("total_lines") * 100).alias("file_size"))
    return markdown_reports(stats, analyses(stats), sizes, moment(AS_OF))


@query("risk_labels", "R2", """
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '🔴 **P0** - 服务完全不可用'
  WHEN 1 THEN '🟡 **P1** - 部分功能受影响' ELSE '🟢 **P2** - 偶发问题' END AS label
FROM customer
""", with_events=False)
def risk_labels(spark, folder) -> DataFrame:
    risk = F.concat(F.lit("P"), (F.col("c_nationkey") % 3).cast("string"))
    return render.table(spark, folder, "customer").select(
        "c_custkey", risk_label(risk).alias("label")
    )


@query("size_format", "R3", """
SELECT doc_id, CASE
  WHEN s < 1024 THEN printf('%.1f', s) || ' B'
  WHEN s < 1024.0 ^ 2 THEN printf('%.1f', s / 1024) || ' KB'
  WHEN s < 1024.0 ^ 3 THEN printf('%.1f', s / 1024 / 1024) || ' MB'
  WHEN s < 1024.0 ^ 4 THEN printf('%.1f', s / 1024 / 1024 / 1024) || ' GB'
  ELSE printf('%.1f', s / 1024 / 1024 / 1024 / 1024) || ' TB' END AS size_text
FROM (SELECT doc_id, (n_chars * CAST(pow(doc_id % 90 + 1, 6) AS BIGINT))::DOUBLE AS s FROM documents)
""", with_events=False)
def size_format(spark, folder) -> DataFrame:
    size = F.col("n_chars") * F.pow(F.col("doc_id") % 90 + 1, F.lit(6)).cast("bigint")
    return render.table(spark, folder, "documents").select(
        "doc_id", format_size(size).alias("size_text")
    )


@query("duration_format", "R4", f"""
SELECT o_orderkey, {_DURATION} AS duration_text
FROM (SELECT o_orderkey, o_totalprice / 20 AS s FROM orders)
""", with_events=False)
def duration_format(spark, folder) -> DataFrame:
    return render.table(spark, folder, "orders").select(
        "o_orderkey", format_duration(F.col("o_totalprice") / 20).alias("duration_text")
    )
