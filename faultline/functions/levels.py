"""Severity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import contains_any

# Level words and what they mean
LEVEL_WORDS = {
    "info": "INFO",
    "warn": "WARN",
    "warning": "WARN",
    "error": "ERROR",
    "err": "ERROR",
    "fatal": "FATAL",
    "crit": "FATAL",
    "critical": "FATAL",
    "debug": "DEBUG",
}

# Kernel priority tags
KERNEL_TAGS = {
    "EMERG": "FATAL",
    "ALERT": "FATAL",
    "CRIT": "FATAL",
    "ERR": "ERROR",
    "WARN": "WARN",
    "NOTICE": "INFO",
    "INFO": "INFO",
    "DEBUG": "DEBUG",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map lookup; NULL for unknown keys."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*entries), key)


def normalize_level(word: Column) -> Column:
    return F.coalesce(lookup(LEVEL_WORDS, F.lower(word)), F.lit("INFO"))


def http_level(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def syslog_level(lowered: Column) -> Column:
    """Level of a syslog message, given in lower case. Substrings count, in this order."""
    return (
        F.when(contains_any(lowered, ["err", "fail"]), "ERROR")
        .when(contains_any(lowered, ["warn"]), "WARN")
        .when(contains_any(lowered, ["fatal", "crit"]), "FATAL")
        .when(contains_any(lowered, ["debug"]), "DEBUG")
        .otherwise("INFO")
    )


def kernel_tag_level(tag: Column) -> Column:
    """Level of a kernel priority tag; NULL when the word is no such tag."""
    return lookup(KERNEL_TAGS, F.upper(tag))


def kernel_message_level(lowered: Column) -> Column:
    """Level the wording of a kernel message implies, or NULL when it implies none."""
    return (
        F.when(contains_any(lowered, ["error", "fail"]), "ERROR")
        .when(contains_any(lowered, ["fatal", "critical", "panic"]), "FATAL")
        .when(contains_any(lowered, ["exception"]), "ERROR")
        .when(contains_any(lowered, ["warn", "timeout"]), "WARN")
        .when(contains_any(lowered, ["abort", "corruption", "bug"]), "ERROR")
    )
