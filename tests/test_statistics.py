"""Statistics, requests, reports and number formats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions.formatting import (
    fixed, format_duration, format_size, grouped, percent, python_datetime, round_exact,
)
from faultline.operators.lineformat import parse_as
from faultline.operators.nginx import Nginx
from faultline.operators.prompt import OPENING, REQUEST, prompt_context
from faultline.operators.stats import (
    error_sample, grouped_entries, level_shares, log_statistics, top_error_types,
)
from faultline.plans.report import markdown_reports


def access(i, status, url):
    return (
        f'10.0.0.1 - - [15/Feb/2026:10:{i // 60:02d}:{i % 60:02d} +0000] "GET {url} HTTP/1.1" '
        f'{status} 1 "-" "x"'
    )


@pytest.fixture
def entries(lines):
    shown = [access(0, 200, "/ok"), access(1, 404, "/no"), access(2, 500, "/b"),
             access(3, 500, "/a"), access(4, 500, "/a"), access(5, 502, "/c"), "noise"]
    return parse_as(lines(*shown), Nginx()).entries


def test_statistics(entries):
    row = log_statistics(entries).collect()[0]
    assert (row["total_lines"], row["error_lines"], row["warning_lines"], row["error_rate"]) == (
        6, 4, 1, 66.67
    )
    assert list(row["level_counts"].items()) == [("INFO", 1), ("WARN", 1), ("ERROR", 4)]
    assert [(t["error_type"], t["count"]) for t in row["error_types"]] == [
        ("GET /a - 500", 2), ("GET /b - 500", 1), ("GET /c - 502", 1)
    ]
    assert row["ts_min"] == datetime(2026, 2, 15, 10) and row["ts_max"].second == 5


def test_no_entries_give_no_row(lines):
    assert log_statistics(parse_as(lines("noise"), Nginx()).entries).count() == 0


def test_statistics_parse_the_lines_once(entries):
    plan = log_statistics(entries)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[text.index("Final Plan"):text.index("Initial Plan")]
    assert final.count("Generate explode(array(split(regexp_replace") == 1
    assert "ReusedExchange" in final


def test_top_types_and_sample_are_bounded_and_ordered(lines):
    shown = [access(i, 500, f"/{i:03d}" + "x" * 60) for i in range(150)]
    found = parse_as(lines(*reversed(shown)), Nginx()).entries
    top = top_error_types(grouped_entries(found)).orderBy("rank").collect()
    assert [t["error_type"][:8] for t in top] == [f"GET /{i}" for i in range(149, 139, -1)]
    assert all(len(t["error_type"]) == 50 for t in top)
    sample = error_sample(found).orderBy("n").collect()
    assert len(sample) == 100 and sample[0]["message"].startswith("GET /149")


def test_level_shares(entries):
    rows = level_shares(log_statistics(entries)).orderBy("position").collect()
    assert [(r["level"], r["percentage"], r["bar"]) for r in rows] == [
        ("INFO", "16.7%", "███"), ("WARN", "16.7%", "███"), ("ERROR", "66.7%", "█" * 13)
    ]


def test_prompt(entries):
    text = prompt_context(log_statistics(entries), entries).collect()[0]["prompt"]
    assert text.startswith(OPENING + "- 总行数: 6\n- 错误行数: 4\n- 警告行数: 1\n- 错误率: 66.67%\n")
    assert "- 时间范围: 2026-02-15 10:00:00 - 2026-02-15 10:00:05\n\n## 日志级别分布\n- INFO: 1\n" in text
    assert "## 错误类型（Top 10）\n- GET /a - 500: 2次\n" in text
    assert text.endswith("[2026-02-15 10:00:05] GET /c - 502\n" + REQUEST)


def analysis(spark, commands):
    return spark.createDataFrame(
        [("a.log", "连接超时", ["防火墙限制", "服务未启动"], "P0", commands, 0.95)],
        "source string, problem_type string, possible_causes array<string>, risk_level string,"
        " suggested_commands array<struct<category:string,description:string,command:string>>,"
        " confidence double",
    )


def test_report(spark, entries):
    commands = [("网络", "一", "ping h"), ("端口", "二", "ss"), ("网络", "三", "mtr h")]
    sizes = spark.createDataFrame([("a.log", 2048)], "source string, file_size bigint")
    stats = log_statistics(entries)
    as_of = F.lit(datetime(2026, 3, 1, 8))
    text = markdown_reports(stats, analysis(spark, commands), sizes, as_of).collect()[0]["report"]
    assert text.startswith("# 网络诊断报告\n\n**生成时间**: 2026-03-01 08:00:00\n\n## 📄 文件信息\n\n")
    for part in (
        "- **文件名**: `a.log`\n- **文件大小**: 2.0 KB\n- **日志格式**: Nginx\n",
        "- **错误率**: 66.67%\n\n### 日志级别分布\n\n- **INFO**: 1 (16.7%) ███\n",
        "- **时长**: 5.0秒\n\n### 错误类型（Top 10）\n\n1. `GET /a - 500` - 2次\n",
        "1. 防火墙限制\n2. 服务未启动\n\n### 风险等级\n\n🔴 **P0** - 服务完全不可用\n",
        "**95.0%**\n\n## 🔧 建议的排查命令\n\n\n### 网络\n\n#### 一\n\n```bash\nping h\n```\n\n#### 三\n",
        "```\n\n\n### 端口\n\n#### 二\n",
    ):
        assert part in text
    none = markdown_reports(stats, analysis(spark, []), sizes, as_of).collect()[0]["report"]
    assert "无建议命令\n\n## 📝 下一步" in none


def test_number_formats(spark):
    values = [0.05, 0.125, 0.25, 0.35, 2.675, 1.005, 0.5, 1.5, 2.5, 99.95, 33.333, 1023.95, 1e9 + 0.05,
              0.0, 16.65, 12.345, 87.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select(
        "v", fixed(v, 1), fixed(v, 0), fixed(v, 2), percent(v), round_exact(v, 2)
    ).collect()
    for x, one, none, two, share, rounded in rows:
        assert (one, none, two, share, rounded) == (
            f"{x:.1f}", f"{x:.0f}", f"{x:.2f}", f"{x:.0%}", round(x, 2)
        )


def test_units(spark):
    df = spark.createDataFrame(
        [(0, 0.0), (1023, 59.96), (1024, 60.0), (1536, 3599.0), (1024**3, 3600.0), (5 * 1024**4, 1e5)],
        "size bigint, seconds double",
    )
    rows = df.select(format_size(F.col("size")), format_duration(F.col("seconds"))).collect()
    assert [tuple(r) for r in rows] == [
        ("0.0 B", "0.0秒"), ("1023.0 B", "60.0秒"), ("1.0 KB", "1.0分钟"), ("1.5 KB", "60.0分钟"),
        ("1.0 GB", "1.0小时"), ("5.0 TB", "27.8小时"),
    ]
    shown = spark.range(1).select(
        grouped(F.lit(1234567)), python_datetime(F.lit(datetime(2026, 1, 2, 3, 4, 5, 60)))
    ).collect()[0]
    assert tuple(shown) == ("1,234,567", "2026-01-02 03:04:05.000060")
