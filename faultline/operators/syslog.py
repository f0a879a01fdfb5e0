"""Syslog lines, RFC 3164 and RFC 5424."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.clock import ASSUMED_YEAR, CLOCK_PARTS, HMS
from faultline.functions.levels import syslog_level
from faultline.functions.text import captures, part
from faultline.operators.lineformat import LineFormat

_OLD = r"(\w+) (\d+) (\d{2}:\d{2}:\d{2}) (\S+) (\S+): (.+)"
# A 5424 time is read when it is ISO with a fraction (the fraction and what follows are cut), or a
# common-log clock; any other text matches without being captured.
_NEW_TIME = (
    rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T({HMS})(\.\S*)"
    rf"|(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):({HMS})(?:\.\S*)?"
    r"|(\S+)"
)
_NEW = rf"<\d+>\d+ (?:{_NEW_TIME}) (\S+) (\S+) \d+ - - (.+)"
_PATTERN = rf"^(?:{_OLD}|{_NEW})$"
# year, month, day, time, no zone; then host, process, message, fraction with offset, unread time
_OUTPUTS = [
    "$7$14", "$1$8$13", "$2$9$12", "$3$10$15", "", "$4$17", "$5$18", "$6$19", "$11", "$16",
]

HEAD_PATTERNS = (
    r"^\w+ \d+ \d{2}:\d{2}:\d{2} \S+ \S+: .+",
    r"(?i)^<\d+>\d+ \S+ \S+ \S+ \d+ - - .+",
)


class Syslog(LineFormat):
    """RFC 3164 has no year: ``assume_year`` supplies it. ``compat`` drops the offset of a 5424
    time and refuses one without a fraction; otherwise both are read as written."""

    name = "syslog"

    def __init__(self, compat: bool = True, assume_year: int | Column = ASSUMED_YEAR):
        self.compat = compat
        self.assume_year = assume_year

    def first(self, line: Column) -> Column:
        return captures(line, _PATTERN, _OUTPUTS)

    def derived(self, line: Column, first: Column, second: Column | None) -> list[dict[str, Column]]:
        return [{"_syslog_text": F.lower(part(first, CLOCK_PARTS + 2))}]

    def timestamp(self, first: Column, second: Column | None) -> Column:
        ts = super().timestamp(first, second)
        if self.compat:
            return ts
        year, month, day, hms, _, _, _, _, tail, unread = (
            part(first, i) for i in range(len(_OUTPUTS))
        )
        exact = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hms, tail)
        return F.coalesce(
            F.when(tail != "", exact.try_cast("timestamp")), ts,
            F.when(unread.rlike(r"^\d{4}-"), unread.try_cast("timestamp")),
        )

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        host, process, message = (part(first, CLOCK_PARTS + i) for i in range(3))
        return {
            "level": syslog_level(F.col("_syslog_text")),
            "message": message,
            "fields": F.create_map(F.lit("host"), host),
            "process": process,
            "host": host,
        }
