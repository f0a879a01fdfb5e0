"""The text that asks a model for a diagnosis, one per source. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.formatting import python_datetime
from faultline.operators.stats import error_sample

# The wording of the request
OPENING = "你是一个网络诊断专家，请分析以下日志：\n\n## 日志摘要\n"
REQUEST = """
## 分析要求
请分析上述日志，找出网络问题的原因。

请输出JSON格式：
{
  "problem_type": "问题类型",
  "possible_causes": ["原因1", "原因2", "原因3"],
  "risk_level": "P0/P1/P2",
  "suggested_commands": [
    {
      "category": "命令分类",
      "description": "命令说明",
      "command": "命令本身"
    }
  ],
  "confidence": 0.95
}

问题类型包括：连接超时、DNS解析失败、端口不可达、高延迟、服务异常、无问题
风险等级：P0（服务完全不可用）、P1（部分功能受影响）、P2（偶发问题）
命令分类包括：网络、端口、DNS、服务、防火墙
"""


def _time(ts: Column) -> Column:
    return F.coalesce(python_datetime(ts), F.lit("None"))


def _joined(lines: Column) -> Column:
    """Lines of an array, each ended by a newline."""
    return F.concat(
        F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")
    )


def prompt_context(stats: DataFrame, entries: DataFrame) -> DataFrame:
    """``source, prompt`` from the statistics and the first errors of each source."""
    sample = (
        error_sample(entries)
        .withColumn("_text", F.concat(F.lit("["), _time(F.col("ts")), F.lit("] "), "message"))
        .groupBy(F.col("file").alias("source"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "_text"))).alias("_errors"))
    )
    levels = F.transform(
        F.map_entries("level_counts"),
        lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string")),
    )
    types = F.transform(
        "error_types",
        lambda e: F.concat(
            F.lit("- "), e["error_type"], F.lit(": "), e["count"].cast("string"), F.lit("次")
        ),
    )
    errors = F.coalesce(F.col("_errors._text"), F.array().cast("array<string>"))
    prompt = F.concat(
        F.lit(OPENING),
        F.lit("- 总行数: "), F.col("total_lines").cast("string"),
        F.lit("\n- 错误行数: "), F.col("error_lines").cast("string"),
        F.lit("\n- 警告行数: "), F.col("warning_lines").cast("string"),
        F.lit("\n- 错误率: "), F.col("error_rate").cast("string"), F.lit("%"),
        F.lit("\n- 时间范围: "), _time(F.col("ts_min")), F.lit(" - "), _time(F.col("ts_max")),
        F.lit("\n\n## 日志级别分布\n"), _joined(levels),
        F.lit("\n## 错误类型（Top 10）\n"), _joined(types),
        F.lit("\n## 错误日志（最近100条）\n"), _joined(errors),
        F.lit(REQUEST),
    )
    return stats.join(sample, "source", "left").select("source", prompt.alias("prompt"))
