"""Which format a file has, judged by its first lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.pyregex import translate
from faultline.functions.text import DIALECT, strip
from faultline.operators import dmesg, haproxy, nginx, syslog
from faultline.operators.custom import ParserConfig

UNKNOWN = "unknown"
HEAD = 10
CUSTOM_HEAD = 20

# The first format that claims a file wins; HAProxy lines would also pass as syslog.
_PROBES = {
    "nginx": (nginx.HEAD_PATTERNS, False),
    "haproxy": (haproxy.HEAD_PATTERNS, False),
    "syslog": (syslog.HEAD_PATTERNS, False),
    "dmesg": (dmesg.HEAD_PATTERNS, True),
}


def head_lines(lines: DataFrame, count: int) -> DataFrame:
    """The first ``count`` lines of each file.

    The rank limit is applied in every task before the shuffle, so a file of any size sends at
    most ``count`` rows per task.
    """
    order = Window.partitionBy("file").orderBy("line_id")
    return (
        lines.select("file", "line_id", "value")
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= count)
        .drop("_n")
    )


def _any_match(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    return reduce(or_, [text.rlike(DIALECT + p) for p in patterns])


def _built_in_hits(counted: Column) -> dict[str, Column]:
    """Aggregates by format: whether a ``counted`` line of a file looks like it."""
    return {
        name: F.max(counted & _any_match(strip(F.col("value")) if stripped else F.col("value"), patterns))
        for name, (patterns, stripped) in _PROBES.items()
    }


def detect_formats(lines: DataFrame) -> DataFrame:
    """``file, format`` with format nginx, haproxy, syslog, dmesg or unknown."""
    hits = _built_in_hits(F.lit(True))
    found = head_lines(lines, HEAD).groupBy("file").agg(*[h.alias(n) for n, h in hits.items()])
    choice = F.coalesce(*[F.when(F.col(name), name) for name in hits], F.lit(UNKNOWN))
    return found.select("file", choice.alias("format"))


def _looks_like(config: ParserConfig) -> Column:
    """An aggregate over the head of a file: whether it looks like a configured format.

    Detection patterns may match anywhere in one of the first lines. Without any, more than half
    of the lines that are not blank have to match the format itself.
    """
    patterns = config.usable_detect_patterns()
    value = F.col("value")
    if patterns:
        return F.max(_any_match(value, patterns))
    line = strip(value)
    hit = line.rlike(f"{DIALECT}^(?:{translate(config.pattern)})")
    share = F.avg(F.when(line != "", hit.cast("int")))
    return F.coalesce(share > 0.5, F.lit(False))


def detect_custom(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """``file, detected``: whether the head of each file looks like a configured format."""
    return head_lines(lines, CUSTOM_HEAD).groupBy("file").agg(_looks_like(config).alias("detected"))


def detect_configured(lines: DataFrame, configs: Sequence[ParserConfig]) -> DataFrame:
    """``file, format``: the first of the configured formats that a file looks like, else its built-in
    format. All are judged in one pass over the heads."""
    heads = head_lines(lines, CUSTOM_HEAD).withColumn(
        "_n", F.row_number().over(Window.partitionBy("file").orderBy("line_id"))
    )
    own = [_looks_like(c).alias(f"_own{i}") for i, c in enumerate(configs)]
    built_in = [h.alias(n) for n, h in _built_in_hits(F.col("_n") <= HEAD).items()]
    found = heads.groupBy("file").agg(*own, *built_in)
    choice = [F.when(F.col(f"_own{i}"), c.name) for i, c in enumerate(configs)]
    choice += [F.when(F.col(name), name) for name in _PROBES]
    return found.select("file", F.coalesce(*choice, F.lit(UNKNOWN)).alias("format"))


def report_format_label(entries: DataFrame) -> DataFrame:
    """``file, file_format``: the label reports show, taken from each file's first entry.

    Nginx when that entry has an address, else Syslog; so HAProxy files count as Nginx and kernel
    logs as Syslog.
    """
    first = F.min("line_id").alias("_first")
    first_with_ip = F.min(F.when(F.col("ip_address") != "", F.col("line_id"))).alias("_with_ip")
    return entries.groupBy("file").agg(first, first_with_ip).select(
        "file",
        F.when(F.col("_with_ip") == F.col("_first"), "Nginx")
        .otherwise("Syslog")
        .alias("file_format"),
    )
