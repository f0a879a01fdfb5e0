"""HAProxy HTTP lines behind a syslog prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.clock import CLOCK_PARTS, bracket_clock
from faultline.functions.levels import http_level
from faultline.functions.text import captures, part
from faultline.operators.lineformat import LineFormat

_CLOCK, _N, _CLOCK_OUT = bracket_clock(2)
_BACKEND = 2 + _N
_PREFIX = r"\w+ \d+ \d{2}:\d{2}:\d{2} \S+ \w+\[\d+\]: "
_TIMERS = r"\d+/\d+/\d+/\d+"
_PATTERN = rf"^{_PREFIX}(\S+):\d+ \[{_CLOCK}\] (\S+) (\S+) {_TIMERS} (\d{{3}}).*$"
_OUTPUTS = [*_CLOCK_OUT, "$1", *[f"${_BACKEND + i}" for i in range(3)]]

HEAD_PATTERNS = (rf"^{_PREFIX}\S+:\d+ \[[^\]]+\] \S+ \S+ {_TIMERS} \d{{3}}",)


class HAProxy(LineFormat):
    """The time is the bracketed accept date. The address ends at its first colon, so IPv6
    addresses are cut short."""

    name = "haproxy"

    def first(self, line: Column) -> Column:
        return captures(line, _PATTERN, _OUTPUTS)

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        ip, backend, server, status_text = (
            part(first, i) for i in range(CLOCK_PARTS, len(_OUTPUTS))
        )
        status = status_text.try_cast("int")
        return {
            "level": http_level(status),
            "message": F.concat(backend, F.lit(" -> "), server, F.lit(": "), status_text),
            "fields": F.create_map().cast("map<string,string>"),
            "ip_address": F.substring_index(ip, ":", 1),
            "status_code": status,
            "backend_name": backend,
            "server_name": server,
        }
