"""The main path: files to entries, statistics and model requests."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from faultline.operators.custom import ParserConfig
from faultline.operators.lineformat import ParsedLines
from faultline.operators.parse import parse_logs
from faultline.operators.prompt import prompt_context
from faultline.operators.stats import log_statistics
from faultline.sources.lines import list_files, read_heads, read_lines


class LogAnalysis(NamedTuple):
    entries: DataFrame
    quarantine: DataFrame
    statistics: DataFrame
    prompts: DataFrame


def analyze_entries(parsed: ParsedLines) -> LogAnalysis:
    """Statistics and requests for parsed lines. Nothing runs until a result is used."""
    statistics = log_statistics(parsed.entries)
    return LogAnalysis(*parsed, statistics, prompt_context(statistics, parsed.entries))


def stored(spark: SparkSession, parsed: ParsedLines, folder: str) -> ParsedLines:
    """The parsed lines written as parquet below ``folder``, and read back from there.

    Statistics and error samples then read the columns they need instead of parsing again.
    """
    tables = []
    for name, table in zip(ParsedLines._fields, parsed):
        path = f"{folder.rstrip('/')}/{name}"
        table.write.mode("overwrite").parquet(path)
        tables.append(spark.read.schema(table.schema).parquet(path))
    return ParsedLines(*tables)


def analyze_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str | None = None,
    max_size: int | None = None,
    compat: bool = True,
    store: str | None = None,
    open_heads: bool = True,
    configs: Sequence[ParserConfig] = (),
) -> LogAnalysis:
    """Detect, parse and analyze log files.

    Detection opens each file for its first lines only; without ``open_heads``, for stores that
    only Spark can read, it takes them from a scan. With ``store``, a folder all executors share, the
    lines are parsed once and kept there; without it every result parses the lines for itself.
    ``configs`` are formats known besides the built-in ones, such as those of a folder.
    """
    lines = read_lines(spark, paths, max_size)
    heads = read_heads(spark, paths) if fmt is None and open_heads else None
    parsed = parse_logs(lines, fmt, heads, compat=compat, configs=configs)
    if store is not None:
        parsed = stored(spark, parsed, store)
    return analyze_entries(parsed)


def file_sizes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``source, file_size`` for reports, from the file listing."""
    return list_files(spark, paths).withColumnRenamed("file", "source")
