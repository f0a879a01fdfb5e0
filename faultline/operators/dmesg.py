"""Kernel ring buffer lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.formatting import plain_number
from faultline.functions.clock import CLOCK_PARTS, HMS
from faultline.functions.levels import kernel_message_level, kernel_tag_level
from faultline.functions.text import (
    captures, contains_any, empty_to_null, matched, part, text_map,
)
from faultline.operators.lineformat import LineFormat

# A weekday makes the bracket a calendar time; a wrong weekday name leaves the time unknown.
_HUMAN = (
    r"\[(?:(?i:mon|tue|wed|thu|fri|sat|sun)\s+([A-Za-z]{3})\s+(\d{1,2})\s+"
    rf"({HMS})\s+(\d{{4}})|[A-Za-z]{{3}}\s+[A-Za-z]{{3}}\s+\d+\s+\d+:\d+:\d+\s+\d+)\]\s*(.+)"
)
_UPTIME = r"\[\s*(\d+\.\d+)\]\s*(?:\[(\w+)\]\s*)?(.+)"
_PATTERN = rf"^(?:{_HUMAN}|{_UPTIME})$"
# year, month, day, time, no zone; then message after a calendar time, uptime, tag, message after
# an uptime
_OUTPUTS = ["$4", "$1", "$2", "$3", "", "$5", "$6", "$7", "$8"]
_HUMAN_MESSAGE, _UPTIME_TEXT, _TAG, _MESSAGE = range(CLOCK_PARTS, len(_OUTPUTS))

HEAD_PATTERNS = (
    r"^\[\s*\d+\.\d+\]",
    r"^\[[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d+:\d+:\d+\s+\d+\]\s*.+$",
)

# Fixed values
NETWORK_SUBSYSTEMS = (
    "eth", "ens", "enp", "wlan", "wlp", "bond", "br", "docker", "veth", "tun", "tap", "bridge",
    "net", "tcp", "udp", "ip", "ipv6", "icmp", "dns",
)
NETWORK_WORDS = (
    "link", "network", "ethernet", "connection", "socket", "packet", "rx", "tx", "dhcp", "arp",
    "route", "dns", "tcp", "udp", "ip", "ipv6", "icmp", "port", "firewall",
)
# A word that holds another one decides nothing.
_DECISIVE_WORDS = [
    w for w in NETWORK_WORDS if not any(o in w for o in NETWORK_WORDS if o != w)
]


class Dmesg(LineFormat):
    """Every line that is not blank gives an entry.

    Only calendar times are known; for the rest ``ts`` is NULL and ``ts_imputed`` is set, unless
    ``boot_ts`` (added to the uptime) or ``ingest_ts`` fills it.
    """

    name = "dmesg"

    def __init__(self, boot_ts: Column | None = None, ingest_ts: Column | None = None):
        self.boot_ts = boot_ts
        self.ingest_ts = ingest_ts

    def first(self, line: Column) -> Column:
        return captures(line, _PATTERN, _OUTPUTS)

    def second(self, line: Column, first: Column) -> Column:
        """Subsystem and message, or the message alone when there is no leading ``word:``."""
        tag, rest = part(first, _TAG), part(first, _MESSAGE)
        human = part(first, _HUMAN_MESSAGE)
        put_back = (tag != "") & kernel_tag_level(tag).isNull()
        text = (
            F.when(~matched(first), line)
            .when(human != "", human)
            .when(put_back, F.concat(F.lit("["), tag, F.lit("] "), rest))
            .otherwise(rest)
        )
        return captures(text, r"^(\w+):\s*(.+)$", 2)

    def derived(self, line: Column, first: Column, second: Column | None) -> list[dict[str, Column]]:
        named = matched(second)
        message = F.when(named, part(second, 1)).otherwise(part(second, 0))
        in_list = F.coalesce(F.col("_subsystem").isin(*NETWORK_SUBSYSTEMS), F.lit(False))
        network = F.col("_network")
        address = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
        return [
            {"_subsystem": F.when(named, F.lower(part(second, 0))), "_message": message},
            {"_kernel_text": F.lower("_message")},
            {"_network": in_list | contains_any(F.col("_kernel_text"), _DECISIVE_WORDS)},
            {
                "_device": F.when(network, empty_to_null(
                    F.regexp_extract("_message", r"(?U)\b(\w+\d+):\s", 1))),
                "_address": F.when(network, empty_to_null(
                    F.regexp_extract("_message", address, 1))),
                "_uptime": part(first, _UPTIME_TEXT).try_cast("double"),
            },
        ]

    def timestamp(self, first: Column, second: Column | None) -> Column:
        ts = super().timestamp(first, second)
        if self.boot_ts is None:
            return ts
        booted = F.timestamp_micros(
            F.unix_micros(self.boot_ts) + F.round(F.col("_uptime") * 1_000_000).cast("bigint")
        )
        return F.coalesce(ts, booted)

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        subsystem, lowered = F.col("_subsystem"), F.col("_kernel_text")
        network, uptime = F.col("_network"), F.col("_uptime")
        fields = {
            "uptime": plain_number(uptime),
            "subsystem": subsystem,
            "network_related": F.when(network, "true"),
            "device": F.col("_device"),
            "ip_address": F.col("_address"),
        }
        entry = {
            "reason": F.lit(None).cast("string"),
            "ts_imputed": F.col("_ts").isNull(),
            "level": F.coalesce(
                kernel_message_level(lowered), kernel_tag_level(part(first, _TAG)), F.lit("INFO")
            ),
            "message": F.col("_message"),
            "fields": text_map(fields),
            "process": F.coalesce(subsystem, F.lit("kernel")),
            "uptime": uptime,
            "subsystem": subsystem,
            "network_related": network,
            "device": F.col("_device"),
            "dev_ip": F.col("_address"),
        }
        if self.ingest_ts is not None:
            entry["ts"] = F.coalesce("_ts", self.ingest_ts)
        return entry
