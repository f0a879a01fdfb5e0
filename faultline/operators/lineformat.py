"""What a log format provides, and the one job that parses lines of any format.

A format is a set of Column expressions: the regex captures of a line, and the entry columns
computed from them. Parsing is a projection over all lines of all files, with no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import ASSUMED_YEAR, CLOCK_PARTS, instant
from faultline.functions.text import bind, matched, part, strip
from faultline.schema import LOG_ENTRY

NO_MATCH = "no_match"
BAD_TIMESTAMP = "bad_timestamp"
BLANK = "blank"

#: Columns a format may set; the rest of an entry comes from the line.
ENTRY_COLUMNS = tuple(f.name for f in LOG_ENTRY.fields if f.name not in ("file", "line_id", "raw"))
_TYPES = {f.name: f.dataType for f in LOG_ENTRY.fields}


class ParsedLines(NamedTuple):
    """``entries`` follow the LOG_ENTRY schema; ``quarantine`` keeps what could not be read.

    Every line that is not blank is in exactly one of the two.
    """

    entries: DataFrame
    quarantine: DataFrame


class LineFormat:
    """Base of the formats.

    Captures of built-in formats start with the clock (year, month, day, time, zone), so that one
    expression reads the time of all of them.
    """

    name: str
    #: The year given to clocks without one.
    assume_year: int | Column = ASSUMED_YEAR

    def first(self, line: Column) -> Column:
        """Captures of the stripped line, as an array."""
        raise NotImplementedError

    def second(self, line: Column, first: Column) -> Column | None:
        """Captures that depend on the first ones, for formats read in two steps."""
        return None

    def derived(self, line: Column, first: Column, second: Column | None) -> list[dict[str, Column]]:
        """Further columns that several entry columns use, level by level."""
        return []

    def timestamp(self, first: Column, second: Column | None) -> Column:
        clock = [part(first, i) for i in range(CLOCK_PARTS)]
        return instant(*clock, assume_year=self.assume_year, short_yearless=True)

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        """Entry columns by name. ``reason`` tells why a line is refused; without it, a line
        must match and have a valid time."""
        raise NotImplementedError


def null_of(name: str) -> Column:
    return F.lit(None).cast(_TYPES[name])


def failure(first: Column, ts: Column) -> Column:
    """Why a line was refused, for formats that need a valid timestamp."""
    return F.when(~matched(first), NO_MATCH).when(ts.isNull(), BAD_TIMESTAMP)


def split_parsed(parsed: DataFrame) -> ParsedLines:
    """Entries and quarantine of a parsed frame that still has ``reason``."""
    entries = parsed.filter(F.col("reason").isNull()).select(*LOG_ENTRY.fieldNames())
    quarantine = parsed.filter(F.col("reason").isin(NO_MATCH, BAD_TIMESTAMP)).select(
        "file", "line_id", "format", "raw", "reason"
    )
    return ParsedLines(entries, quarantine)


def parse_frame(lines: DataFrame, fmt: LineFormat) -> DataFrame:
    """LOG_ENTRY columns plus ``reason``, one row per line."""
    df = lines.withColumn("_line", strip(F.col("value")))
    line = F.col("_line")
    df = bind(df, "_first", fmt.first(line))
    first = F.col("_first")
    second = fmt.second(line, first)
    if second is not None:
        df = bind(df, "_second", second)
        second = F.col("_second")
    for level in fmt.derived(line, first, second):
        df = df.withColumns(level)
    df = bind(df, "_ts", fmt.timestamp(first, second))
    found = fmt.entry(line, first, second)
    reason = found.pop("reason", failure(first, F.col("_ts")))
    columns = {name: null_of(name) for name in ENTRY_COLUMNS if name != "ts"}
    columns |= {"ts_imputed": F.lit(False), "format": F.lit(fmt.name)} | found
    columns.setdefault("ts", F.col("_ts"))
    return df.select(
        "file", "line_id",
        *[columns[name].cast(_TYPES[name]).alias(name) for name in ENTRY_COLUMNS],
        line.alias("raw"),
        F.when(line == "", BLANK).otherwise(reason).alias("reason"),
    )


def parse_as(lines: DataFrame, fmt: LineFormat) -> ParsedLines:
    """Parse all lines with one format."""
    return split_parsed(parse_frame(lines, fmt))
