"""Timestamps: the clock shapes found in logs, and strptime formats from user configuration.

Every shape is captured by a regex into calendar parts, then glued to an ISO text that Spark's
timestamp cast reads. The cast is far cheaper than a formatter pattern, and it validates ranges.
Text without an offset is read as UTC.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.levels import lookup
from faultline.functions.text import captures, empty_to_null, matched, part

# Fixed values
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
WEEKDAY_NAMES = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)

#: Number of parts a clock has: year, month, day, time, zone.
CLOCK_PARTS = 5

#: The year a clock without one is given.
ASSUMED_YEAR = 1900

_MONTH_NUMBERS = {
    name: f"{i:02d}" for names in (MONTHS, MONTH_NAMES) for i, name in enumerate(names, 1)
}

HMS = r"\d{1,2}:\d{1,2}:\d{1,2}"
ZONE = r"[+-]\d{2}:?[0-5]\d(?::?[0-5]\d)?|Z"


def instant(
    year: Column, month: Column, day: Column, hms: Column, zone: Column | None = None,
    assume_year: int | Column = ASSUMED_YEAR, short_yearless: bool = False,
) -> Column:
    """Timestamp of textual calendar parts; NULL when they are no valid date.

    An empty year means the assumed one; month may be a number or a name; an empty zone is UTC.
    With ``short_yearless`` a clock without a year needs the short name of its month.
    """
    assumed = assume_year if isinstance(assume_year, Column) else F.lit(str(assume_year))
    utc = F.lit("Z")
    name = F.lower(month)
    number = F.coalesce(lookup(_MONTH_NUMBERS, name), month)
    if short_yearless:
        number = F.when((year != "") | name.isin(*MONTHS), number)
    return F.concat(
        F.coalesce(empty_to_null(year), assumed.cast("string")), F.lit("-"),
        number, F.lit("-"),
        day, F.lit(" "), hms,
        utc if zone is None else F.coalesce(empty_to_null(zone), utc),
    ).try_cast("timestamp")


def moment(when: datetime) -> Column:
    """A point in time as a literal; without an offset it is UTC, whatever the machine's zone."""
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    return F.lit(when.isoformat(sep=" ")).cast("timestamp")


def bracket_clock(first: int) -> tuple[str, int, list[str]]:
    """Pattern of the text inside ``[...]`` whose groups start at ``first``.

    Accepts the common-log clock with and without offset, ISO with a blank, and the yearless
    syslog clock. One fraction is cut off together with whatever follows it. Anything else still
    matches but captures nothing, so the instant is NULL. Returns the pattern, the number of
    groups and the output templates (year, month, day, time, zone).
    """
    fraction = r"(?:\.[^.\]]*(?<![+-]))?"
    pattern = (
        rf"(?:(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):({HMS})(?:\s+({ZONE})|{fraction})"
        rf"|(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})\s+({HMS}){fraction}"
        rf"|([A-Za-z]{{3}})\s+(\d{{1,2}})\s+({HMS}){fraction}"
        r"|[^\]]+)"
    )
    g = [f"${first + i}" for i in range(12)]
    outputs = [g[2] + g[5], g[1] + g[6] + g[9], g[0] + g[7] + g[10], g[3] + g[8] + g[11], g[4]]
    return pattern, 12, outputs


def extract_timestamp(text: Column, assume_year: int | Column = ASSUMED_YEAR) -> Column:
    """Timestamp of a text in one of the four accepted clock shapes, else NULL."""
    pattern, _, outputs = bracket_clock(1)
    parts = captures(text, f"^{pattern}$", outputs)
    clock = [part(parts, i) for i in range(CLOCK_PARTS)]
    return F.when(matched(parts), instant(*clock, assume_year=assume_year))


class UnsupportedFormat(ValueError):
    """A strptime directive or regex construct that has no Spark counterpart."""


# What each strptime directive accepts
_DIRECTIVES = {
    "Y": r"\d{4}",
    "y": r"\d{2}",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "d": r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]",
    "H": r"2[0-3]|[01]\d|\d",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5]\d|\d",
    "S": r"6[01]|[0-5]\d|\d",
    "f": r"\d{1,6}",
    "j": r"36[0-6]|3[0-5]\d|[12]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9]",
    "p": r"am|pm",
    "z": ZONE,
    "Z": r"utc|gmt",
    "b": "|".join(MONTHS),
    "B": "|".join(sorted(MONTH_NAMES, key=len, reverse=True)),
    "a": "|".join(WEEKDAYS),
    "A": "|".join(WEEKDAY_NAMES),
}
# Directives that say the same thing share a slot.
_SLOT_OF = {"m": "month", "b": "month", "B": "month", "Y": "year", "y": "short_year", "d": "day",
            "H": "hour", "I": "hour12", "M": "minute", "S": "second", "f": "fraction",
            "z": "zone", "p": "half", "j": "year_day"}
_SLOTS = ("year", "short_year", "month", "day", "hour", "hour12", "minute", "second", "fraction",
          "zone", "half", "year_day")


@dataclass(frozen=True)
class TimeFormat:
    """A strptime format, compiled to one regex and a timestamp expression."""

    text: str
    pattern: str
    outputs: tuple[str, ...]
    slots: frozenset[str]

    @classmethod
    def compile(cls, text: str) -> "TimeFormat":
        pattern, seen, group = "", {}, 0
        for token in re.findall(r"%.|\s+|[^%\s]+|%$", text):
            if token.isspace():
                pattern += r"\s+"
            elif not token.startswith("%"):
                pattern += re.sub(r"([^\w])", r"\\\1", token)
            elif token == "%%":
                pattern += "%"
            elif token[1:] not in _DIRECTIVES:
                raise UnsupportedFormat(f"time directive {token!r} in {text!r} is not supported")
            elif (slot := _SLOT_OF.get(token[1])) is None:
                pattern += f"(?:{_DIRECTIVES[token[1]]})"
            elif slot in seen:
                raise UnsupportedFormat(f"{text!r} states the {slot} twice")
            else:
                group += 1
                seen[slot] = group
                pattern += f"({_DIRECTIVES[token[1]]})"
        outputs = tuple(f"${seen[s]}" if s in seen else "" for s in _SLOTS)
        return cls(text, f"^(?i:{pattern})$", outputs, frozenset(seen))

    def parts(self, value: Column) -> Column:
        return captures(value, self.pattern, self.outputs)

    def read(self, parts: Column, assume_year: int | Column = ASSUMED_YEAR) -> Column:
        """Timestamp of :meth:`parts`; NULL when the format did not match."""
        slot = {name: part(parts, i) for i, name in enumerate(_SLOTS)}
        has = self.slots.__contains__

        year = slot["year"]
        if has("short_year") and not has("year"):
            short = slot["short_year"]
            year = F.concat(F.when(short >= "69", "19").otherwise("20"), short)
        month = slot["month"] if has("month") else F.lit("1")
        day = F.ltrim(slot["day"]) if has("day") else F.lit("1")
        hour = slot["hour"] if has("hour") else F.lit("0")
        if has("hour12"):
            afternoon = F.lower(slot["half"]) == "pm" if has("half") else F.lit(False)
            hour = (
                slot["hour12"].try_cast("int") % 12 + F.when(afternoon, 12).otherwise(0)
            ).cast("string")
        minute = slot["minute"] if has("minute") else F.lit("0")
        second = slot["second"] if has("second") else F.lit("0")
        pieces = [hour, F.lit(":"), minute, F.lit(":"), second]
        if has("fraction"):
            pieces += [F.lit("."), slot["fraction"]]
        zone = slot["zone"] if has("zone") else None
        when = instant(year, month, day, F.concat(*pieces), zone, assume_year)
        if has("year_day") and not (has("month") and has("day")):
            offset = slot["year_day"].try_cast("int") - 1
            when = when + F.make_dt_interval(offset)
        return F.when(matched(parts), when)

    def parse(self, value: Column, assume_year: int | Column = ASSUMED_YEAR) -> Column:
        return self.read(self.parts(value), assume_year)
