"""Parsing of mixed files, each with its own format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import bind, strip
from faultline.operators.custom import CustomFormat, ParserConfig
from faultline.operators.detect import UNKNOWN, detect_configured, detect_formats
from faultline.operators.dmesg import Dmesg
from faultline.operators.haproxy import HAProxy
from faultline.operators.lineformat import (
    BLANK, ENTRY_COLUMNS, LineFormat, ParsedLines, failure, null_of, parse_as,
)
from faultline.operators.nginx import Nginx
from faultline.operators.syslog import Syslog
from faultline.schema import LOG_ENTRY

UNKNOWN_FORMAT = "unknown_format"

#: Beyond this many files the format table is not broadcast by hint; Spark then picks the join.
BROADCAST_FILES = 100_000


def builtin_formats(compat: bool = True) -> dict[str, LineFormat]:
    formats: tuple[LineFormat, ...] = (Nginx(compat), HAProxy(), Syslog(compat), Dmesg())
    return {fmt.name: fmt for fmt in formats}


def attach_formats(lines: DataFrame, formats: DataFrame, files: int | None = None) -> DataFrame:
    """Lines with the ``format`` of their file.

    ``files`` is the number of rows in ``formats`` when it is known, for instance from the file
    listing. Up to ``BROADCAST_FILES`` the table is small enough to go to every executor and the
    lines are not shuffled.
    """
    if files is not None and files <= BROADCAST_FILES:
        formats = F.broadcast(formats)
    return lines.join(formats, "file", "left")


def parse_mixed(
    lines: DataFrame, compat: bool = True, configured: Sequence[LineFormat] = ()
) -> ParsedLines:
    """Parse lines that carry a ``format`` column, each line with the rules of its format.

    ``configured`` formats are read in the same pass as the built-in ones; one of the same name as a
    built-in format takes its place. Lines of unknown format are quarantined as such.
    """
    own = {fmt.name: fmt for fmt in configured}
    if len(own) < len(configured):
        raise ValueError("Configured formats need names of their own")
    formats = builtin_formats(compat) | own
    name, line, kind = F.col("format"), F.col("_line"), F.col("_kind")
    kinds = {key: i for i, key in enumerate(formats)}
    number = F.coalesce(*[F.when(name == key, i) for key, i in kinds.items()])
    df = lines.withColumns({"_line": strip(F.col("value")), "_kind": number})

    def pick(values: dict[str, Column]) -> Column:
        chain = F
        for key, value in values.items():
            chain = chain.when(kind == kinds[key], value)
        return chain

    df = bind(df, "_first", pick({n: f.first(line) for n, f in formats.items()}))
    first = F.col("_first")
    seconds = {n: f.second(line, first) for n, f in formats.items()}
    df = bind(df, "_second", pick({n: s for n, s in seconds.items() if s is not None}))
    second = F.col("_second")
    for fmt in formats.values():
        for level in fmt.derived(line, first, second):
            df = df.withColumns({c: pick({fmt.name: v}) for c, v in level.items()})
    # The clock sits in the same place in the captures of all built-in formats.
    ts = LineFormat().timestamp(first, second)
    apart = {n: f.timestamp(first, second) for n, f in formats.items() if n in own or n == "syslog" and not compat}
    if apart:
        ts = pick(apart).otherwise(ts)
    df = bind(df, "_ts", ts)
    found = {n: f.entry(line, first, second) for n, f in formats.items()}
    own_reasons = {n: e.pop("reason") for n, e in found.items() if "reason" in e}
    reason = (
        F.when(line == "", BLANK)
        .when(kind.isNull(), UNKNOWN_FORMAT)
        .otherwise(pick(own_reasons).otherwise(failure(first, F.col("_ts"))))
    )
    columns = {}
    for column in ENTRY_COLUMNS:
        values = {n: e[column] for n, e in found.items() if column in e}
        columns[column] = pick(values) if values else null_of(column)
    # Some formats put another time where theirs cannot be read.
    times = {n: e["ts"] for n, e in found.items() if "ts" in e}
    columns |= {
        "ts": pick(times).otherwise(F.col("_ts")) if times else F.col("_ts"),
        "format": F.coalesce(name, F.lit(UNKNOWN)),
        "ts_imputed": F.coalesce(columns["ts_imputed"], F.lit(False)),
    }
    types = {f.name: f.dataType for f in LOG_ENTRY.fields}
    parsed = df.select(
        "file", "line_id", *[columns[c].cast(types[c]).alias(c) for c in ENTRY_COLUMNS],
        line.alias("raw"), reason.alias("reason"),
    )
    entries = parsed.filter(F.col("reason").isNull()).select(*LOG_ENTRY.fieldNames())
    quarantine = parsed.filter(F.col("reason") != BLANK).select(
        "file", "line_id", "format", "raw", "reason"
    )
    return ParsedLines(entries, quarantine)


def parse_logs(
    lines: DataFrame,
    fmt: str | None = None,
    heads: DataFrame | None = None,
    files: int | None = None,
    compat: bool = True,
    configs: Sequence[ParserConfig] = (),
) -> ParsedLines:
    """Parse with the named format, or detect the format of every file first.

    Formats of ``configs`` are known besides the built-in ones, and detected before them.
    ``heads`` may hold the first lines of each file, so that detection need not read ``lines``.
    ``files`` is their number if known: with it the lines are not shuffled to learn their format.
    """
    if fmt is not None:
        formats = builtin_formats(compat) | {c.name: CustomFormat(c) for c in configs}
        if fmt not in formats:
            raise ValueError(f"Unsupported log format: {fmt}")
        return parse_as(lines, formats[fmt])
    shown = lines if heads is None else heads
    detected = detect_configured(shown, configs) if configs else detect_formats(shown)
    return parse_mixed(attach_formats(lines, detected, files), compat, [CustomFormat(c) for c in configs])
