"""Nginx access and error lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.clock import CLOCK_PARTS, bracket_clock
from faultline.functions.levels import http_level, normalize_level
from faultline.functions.text import captures, part, strip
from faultline.operators.lineformat import LineFormat

_CLOCK, _N, _CLOCK_OUT = bracket_clock(2)
_METHOD = 2 + _N
_ERROR = _METHOD + 4

# One regex for both kinds: access lines first, then error lines.
_ACCESS_TEXT = rf'(\S+) \S+ \S+ \[{_CLOCK}\] "(\S+) (\S+) HTTP/\d\.\d" (\d{{3}}) (\d+)'
_ERROR_TEXT = r"(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2}) \[(\w+)\]"
_PATTERN = rf"^(?:{_ACCESS_TEXT}|{_ERROR_TEXT}).*$"
_OUTPUTS = [
    *[f"{clock}${_ERROR + i}" for i, clock in enumerate(_CLOCK_OUT[:4])],
    _CLOCK_OUT[4],
    "$1",
    *[f"${_METHOD + i}" for i in range(4)],
    f"${_ERROR + 4}",
]

# For detection, which looks at unstripped lines.
HEAD_PATTERNS = (
    r'^\S+ \S+ \S+ \[[^\]]+\] "\S+ \S+ HTTP/\d\.\d" \d{3} \d+',
    r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[\w+\]",
)


class Nginx(LineFormat):
    """``compat`` keeps the error message as everything after the line's first colon, which lies
    inside the clock; without it the message is the text after the level."""

    name = "nginx"

    def __init__(self, compat: bool = True):
        self.compat = compat

    def first(self, line: Column) -> Column:
        return captures(line, _PATTERN, _OUTPUTS)

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        ip, method, url, status_text, size, word = (
            part(first, i) for i in range(CLOCK_PARTS, len(_OUTPUTS))
        )
        access = status_text != ""
        status = status_text.try_cast("int")
        start = F.locate(":", line) if self.compat else F.locate("]", line)
        error_message = strip(F.substring(line, start + 1, F.length(line)))

        def if_access(value: Column) -> Column:
            return F.when(access, value)

        size = if_access(size)
        return {
            "level": F.when(access, http_level(status)).otherwise(normalize_level(word)),
            "message": F.when(
                access, F.concat(method, F.lit(" "), url, F.lit(" - "), status_text)
            ).otherwise(error_message),
            "fields": F.when(access, F.create_map(F.lit("size"), size)).otherwise(
                F.create_map().cast("map<string,string>")
            ),
            "ip_address": if_access(ip),
            "request_method": if_access(method),
            "request_url": if_access(url),
            "status_code": if_access(status),
            "size": size.try_cast("bigint"),
        }
