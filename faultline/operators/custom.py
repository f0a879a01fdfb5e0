"""User-defined line formats: a regex, group numbers and a strptime format."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.formatting import plain_number
from faultline.functions.clock import TimeFormat, UnsupportedFormat
from faultline.functions.levels import lookup, normalize_level
from faultline.functions.pyregex import group_count, optional_groups, translate
from faultline.functions.text import captures, empty_to_null, matched, part, strip, text_map
from faultline.operators.lineformat import NO_MATCH, LineFormat


class ParseError(ValueError):
    """A parser configuration that cannot be used."""


@dataclass(frozen=True)
class FieldMapping:
    name: str
    pattern_group: int = 0
    transform: str | None = None
    default: Any = None


@dataclass(frozen=True)
class ParserConfig:
    """One custom format. Group 0, like a negative index, means the last group."""

    name: str = "custom"
    description: str = ""
    pattern: str = ""
    timestamp_format: str = "%Y-%m-%d %H:%M:%S"
    timestamp_group: int = 1
    level_group: int | None = None
    message_group: int = 2
    field_mappings: tuple[FieldMapping, ...] = ()
    level_mapping: Mapping[str, str] = field(default_factory=dict)
    sample_lines: tuple[str, ...] = ()
    multiline: bool = False
    multiline_pattern: str | None = None
    detect_patterns: tuple[str, ...] = ()
    #: Formats tried after ``timestamp_format``.
    more_timestamp_formats: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "ParserConfig":
        """Configuration from plain data, as read from YAML; absent keys take the defaults."""
        if not isinstance(data, Mapping):
            raise ParseError("a parser configuration must be a mapping")
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
        known["field_mappings"] = tuple(
            FieldMapping(
                mapping.get("name", ""), mapping.get("pattern_group", 0),
                mapping.get("transform"), mapping.get("default"),
            )
            for mapping in data.get("field_mappings", ())
        )
        for name in ("sample_lines", "detect_patterns", "more_timestamp_formats"):
            known[name] = tuple(data.get(name, ()))
        return cls(**known).checked()

    def checked(self) -> "ParserConfig":
        """Self, after making sure that the regexes and the time format can be compiled."""
        patterns = {"regex": self.pattern}
        if self.multiline and self.multiline_pattern:
            patterns["multiline"] = self.multiline_pattern
        for kind, pattern in patterns.items():
            try:
                translate(pattern)
            except (re.error, UnsupportedFormat) as error:
                raise ParseError(f"Invalid {kind} pattern: {error}") from error
        try:
            for text in (self.timestamp_format, *self.more_timestamp_formats):
                TimeFormat.compile(text)
        except UnsupportedFormat as error:
            raise ParseError(str(error)) from error
        return self

    def usable_detect_patterns(self) -> list[str]:
        """Detection regexes in Java syntax; ones that do not compile are left out."""
        usable = []
        for pattern in self.detect_patterns:
            try:
                usable.append(translate(pattern))
            except (re.error, UnsupportedFormat):
                continue
        return usable


class CustomFormat(LineFormat):
    """Entries of a configured format.

    A line that matches always gives an entry: a timestamp that cannot be read is NULL (or
    ``ingest_ts``) with ``ts_imputed`` set.
    """

    def __init__(self, config: ParserConfig, ingest_ts: Column | None = None):
        self.config = config.checked()
        self.name = config.name
        self.ingest_ts = ingest_ts
        self.groups = group_count(config.pattern)
        self.optional = optional_groups(config.pattern)
        self.time = TimeFormat.compile(config.timestamp_format)
        self.more_times = [TimeFormat.compile(text) for text in config.more_timestamp_formats]

    def first(self, line: Column) -> Column:
        outputs = [f"${i}" for i in range(1, self.groups + 1)]
        outputs += [""] * (2 - len(outputs))
        return captures(line, rf"^(?:{translate(self.config.pattern)}).*$", outputs)

    def _group(self, first: Column, number: int) -> Column | None:
        """Text of a group, counted from 1; None for one that the pattern does not have."""
        if number > self.groups or not self.groups:
            return None
        return part(first, (number - 1) % self.groups)

    def second(self, line: Column, first: Column) -> Column:
        text = self._group(first, self.config.timestamp_group)
        if text is None:
            text = F.lit("")
        return self.time.parts(F.coalesce(text, F.lit("")))

    def timestamp(self, first: Column, second: Column | None) -> Column:
        ts = self.time.read(second)
        text = self._group(first, self.config.timestamp_group)
        if text is not None and self.more_times:
            ts = F.coalesce(ts, *[fmt.parse(text) for fmt in self.more_times])
        return ts

    def entry(self, line: Column, first: Column, second: Column | None) -> dict[str, Column]:
        config = self.config
        level = F.lit("INFO")
        word = self._group(first, config.level_group) if config.level_group else None
        if word is not None:
            upper = F.upper(strip(word))
            level = normalize_level(upper)
            if config.level_mapping:
                level = F.coalesce(lookup(dict(config.level_mapping), upper), level)
            level = F.when(word == "", "INFO").otherwise(level)

        message = self._group(first, config.message_group)
        fields = {m.name: self._field(first, m) for m in config.field_mappings}
        entry = {
            "reason": F.when(~matched(first), NO_MATCH),
            "ts_imputed": F.col("_ts").isNull(),
            "level": level,
            "message": F.lit("") if message is None else message,
            "fields": text_map(fields, always=self._always_present()),
        }
        if self.ingest_ts is not None:
            entry["ts"] = F.coalesce("_ts", self.ingest_ts)
        return entry

    def _always_present(self) -> list[str]:
        """Fields that every matching line has: text of a group that takes part in any match."""
        names = []
        for m in self.config.field_mappings:
            usable = m.pattern_group <= self.groups and self.groups
            group = ((m.pattern_group - 1) % self.groups) + 1 if usable else None
            if m.default is not None or (
                group is not None and group not in self.optional
                and m.transform not in ("int", "float")
            ):
                names.append(m.name)
        return names

    def _field(self, first: Column, mapping: FieldMapping) -> Column:
        default = F.lit(_default_text(mapping.default))
        number = mapping.pattern_group
        value = self._group(first, number)
        if value is None:
            return default
        if ((number - 1) % self.groups) + 1 in self.optional:
            value = empty_to_null(value)
        return F.coalesce(_transformed(value, mapping.transform), default)


def _default_text(default: Any) -> str | None:
    if default is None:
        return None
    if isinstance(default, bool):
        return str(default).lower()
    return str(default)


def _transformed(value: Column, transform: str | None) -> Column:
    """The value as ``transform`` reads it, in text form; NULL when it cannot."""
    if transform == "int":
        whole = value.rlike(r"(?U)^\s*[+-]?\d+(?:_\d+)*\s*$")
        number = F.replace(strip(value), F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
        # Plain numbers take the cheap cast; the rest is whatever else int() accepts.
        return F.coalesce(
            value.try_cast("bigint").cast("string"), F.when(whole, number.cast("string"))
        )
    if transform == "float":
        real = value.rlike(
            r"(?Ui)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*$"
        )
        return F.when(real, plain_number(strip(value).try_cast("double")))
    if transform == "bool":
        return F.lower(value).isin("true", "1", "yes", "on").cast("string")
    return value
