"""Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.formatting import (
    fixed, format_duration, format_size, grouped, level_bar, percent, python_datetime, risk_label,
)
from faultline.plans.documents import Section, assemble

FOOTER = "*本报告由系统自动生成*"

# How a hypothesis' status reads in a diagnosis report
STATUS_TEXT = {"confirmed": "✓ 已确认", "rejected": "✗ 已排除", "active": "? 待验证"}


def _texts() -> Column:
    return F.array().cast("array<string>")


def _numbered(items: Column) -> Column:
    """``1. item`` lines of an array of texts."""
    return F.transform(
        items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    )


def _file_lines(generated: Column) -> Column:
    name = F.element_at(F.split("source", "/"), -1)
    return F.array(
        F.lit("# 网络诊断报告\n"),
        F.concat(F.lit("**生成时间**: "), generated, F.lit("\n")),
        F.lit("## 📄 文件信息\n"),
        F.concat(F.lit("- **文件名**: `"), name, F.lit("`")),
        F.concat(F.lit("- **文件大小**: "), format_size(F.col("file_size"))),
        F.concat(F.lit("- **日志格式**: "), "file_format"),
        F.concat(F.lit("- **分析时间**: "), generated, F.lit("\n")),
    )


def _overview_lines() -> Column:
    def level_line(entry: Column) -> Column:
        share = entry["value"] / F.col("total_lines") * 100
        return F.concat(
            F.lit("- **"), entry["key"], F.lit("**: "), grouped(entry["value"]), F.lit(" ("),
            fixed(share, 1), F.lit("%) "), level_bar(share),
        )

    def type_line(entry: Column, i: Column) -> Column:
        return F.concat(
            (i + 1).cast("string"), F.lit(". `"), entry["error_type"], F.lit("` - "),
            entry["count"].cast("string"), F.lit("次"),
        )

    seconds = (F.unix_micros("ts_max") - F.unix_micros("ts_min")) / 1_000_000
    times = F.when(
        F.col("ts_min").isNotNull(),
        F.array(
            F.concat(F.lit("- **开始**: "), python_datetime(F.col("ts_min"))),
            F.concat(F.lit("- **结束**: "), python_datetime(F.col("ts_max"))),
            F.concat(F.lit("- **时长**: "), format_duration(seconds)),
        ),
    ).otherwise(_texts())
    types = F.when(
        F.size("error_types") > 0, F.transform("error_types", type_line)
    ).otherwise(F.array(F.lit("无错误日志")))
    return F.concat(
        F.array(
            F.lit("## 📊 日志概览\n"),
            F.concat(F.lit("- **总日志行数**: "), grouped(F.col("total_lines"))),
            F.concat(F.lit("- **错误行数**: "), grouped(F.col("error_lines"))),
            F.concat(F.lit("- **警告行数**: "), grouped(F.col("warning_lines"))),
            F.concat(F.lit("- **错误率**: "), F.col("error_rate").cast("string"), F.lit("%")),
            F.lit("\n### 日志级别分布\n"),
        ),
        F.transform(F.map_entries("level_counts"), level_line),
        F.array(F.lit("\n### 时间范围\n")),
        times,
        F.array(F.lit("\n### 错误类型（Top 10）\n")),
        types,
    )


def command_lines(commands: Column) -> Column:
    """Suggestions grouped by category, categories in the order they first appear."""
    def of_category(category: Column) -> Column:
        own = F.filter(commands, lambda c: c["category"].eqNullSafe(category))
        blocks = F.transform(
            own,
            lambda c: F.concat(
                F.lit("#### "), c["description"], F.lit("\n\n```bash\n"), c["command"],
                F.lit("\n```\n"),
            ),
        )
        return F.concat(F.array(F.concat(F.lit("\n### "), category, F.lit("\n"))), blocks)

    categories = F.array_distinct(F.transform(commands, lambda c: c["category"]))
    return F.when(
        F.size(commands) > 0, F.flatten(F.transform(categories, of_category))
    ).otherwise(F.array(F.lit("无建议命令")))


def _analysis_lines() -> Column:
    return F.concat(
        F.array(
            F.lit("\n## 🤖 AI分析结果\n"),
            F.lit("### 问题类型\n"),
            F.concat(F.lit("**"), "problem_type", F.lit("**")),
            F.lit("\n### 可能原因\n"),
        ),
        _numbered(F.col("possible_causes")),
        F.array(
            F.lit("\n### 风险等级\n"),
            risk_label(F.col("risk_level")),
            F.lit("\n### 置信度\n"),
            F.concat(F.lit("**"), fixed(F.col("confidence") * 100, 1), F.lit("%**")),
            F.lit("\n## 🔧 建议的排查命令\n"),
        ),
        command_lines(F.col("suggested_commands")),
        F.array(
            F.lit("\n## 📝 下一步\n"),
            F.lit("1. 执行上述命令收集更多信息"),
            F.lit("2. 根据结果调整排查方向"),
            F.lit("3. 如需进一步分析，可提供更多日志"),
        ),
    )


def markdown_reports(
    stats: DataFrame,
    analyses: DataFrame,
    sizes: DataFrame,
    as_of: Column,
    footer: str = FOOTER,
) -> DataFrame:
    """``source, report``: one document per source that has both statistics and an analysis.

    ``sizes`` has ``source, file_size``; sources missing there count as empty. ``as_of`` is the time
    the report states.
    """
    generated = F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")
    data = (
        stats.join(analyses, "source")
        .join(sizes.select("source", "file_size"), "source", "left")
        .withColumn("file_size", F.coalesce("file_size", F.lit(0)))
    )
    lines = F.concat(
        _file_lines(generated), _overview_lines(), _analysis_lines(),
        F.array(F.lit("\n---\n"), F.lit(footer + "\n")),
    )
    # Python leaves no line out; a NULL text would be dropped by the join below.
    shown = F.transform(lines, lambda x: F.coalesce(x, F.lit("None")))
    return data.select("source", F.array_join(shown, "\n").alias("report"))


def diagnosis_reports(
    sessions: DataFrame,
    facts: DataFrame,
    hypotheses: DataFrame,
    executed: DataFrame,
    as_of: Column,
) -> DataFrame:
    """``session_id, section, place, pos, line``: what each session found, did and advises.

    The lines of a report are those of :func:`faultline.plans.documents.assemble`. ``sessions`` has
    ``session_id, rounds`` and the analysis columns (NULL ``problem_type`` when there was no analysis);
    ``executed`` has ``session_id, seq, command``.
    """
    certainty = F.concat(F.lit(" (置信度: "), percent(F.col("confidence")), F.lit(")"))

    def few(rows: DataFrame, lines: Column) -> DataFrame:
        return rows.select("session_id", F.posexplode(lines).alias("pos", "line"))

    head = few(sessions, F.array(
        F.lit("# 网络诊断报告"), F.lit(""),
        F.concat(F.lit("**诊断时间**: "), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("**执行轮次**: "), F.col("rounds").cast("string")),
    ))
    analysed = sessions.filter(F.col("problem_type").isNotNull())
    overview = few(analysed, F.array(
        F.concat(F.lit("- **问题类型**: "), "problem_type"),
        F.concat(F.lit("- **风险等级**: "), "risk_level"),
        F.concat(F.lit("- **置信度**: "), percent(F.col("confidence"))),
    ))
    status = F.coalesce(
        *[F.when(F.col("status") == k, v) for k, v in STATUS_TEXT.items()], F.col("status")
    )
    steps = few(analysed, F.concat(
        F.array(F.lit("## 建议的排查步骤"), F.lit("")), _numbered(F.col("possible_causes"))
    ))
    sections = [
        Section(None, head),
        Section("## 问题概述", overview, gap=True),
        Section("## 发现的事实", facts.select(
            "session_id", F.col("position").alias("pos"),
            F.concat(F.lit("- "), "fact", certainty).alias("line"),
        ), gap=True),
        Section("## 假设验证", hypotheses.select(
            "session_id", F.col("hypothesis_id").alias("pos"),
            F.concat(F.lit("- "), status, F.lit(": "), "hypothesis", certainty).alias("line"),
        ), gap=True),
        Section("## 执行的诊断命令", executed.select(
            "session_id", F.col("seq").alias("pos"),
            F.concat(F.lit("- `"), "command", F.lit("`")).alias("line"),
        ), gap=True),
        Section(None, steps),
    ]
    return assemble("session_id", sections)
