"""String helpers that keep Python's text semantics on JVM expressions."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points Python's str.strip() removes
WHITESPACE = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
_WHITESPACE_TEXT = "".join(map(chr, WHITESPACE))

#: Unicode-aware classes, and only "\n" as a line end: how Python reads the same pattern.
DIALECT = "(?Ud)"


def _is_space(char: Column) -> Column:
    code = F.ascii(char)
    return (code <= 32) | code.isin(*[c for c in WHITESPACE if c > 32])


def strip(text: Column) -> Column:
    """``str.strip()``. The edges are looked at first, since trimming a set is the costly part."""
    edge = _is_space(F.substring(text, 1, 1)) | _is_space(F.substring(text, -1, 1))
    return F.when(edge, F.btrim(text, F.lit(_WHITESPACE_TEXT))).otherwise(text)


def captures(text: Column, pattern: str, outputs: Sequence[str] | int) -> Column:
    """All wanted groups of ``pattern`` with one run of the regex, as ``array<string>``.

    ``pattern`` has to consume the whole line. ``outputs`` are replacement templates such as
    ``$1`` or ``$2$7`` (a number n stands for ``$1`` .. ``$n``). A line that does not match comes
    back as a one-element array, so test with :func:`matched`. Lines hold no newline, which makes
    it a safe separator. Needs two outputs or more.
    """
    wanted = [f"${i}" for i in range(1, outputs + 1)] if isinstance(outputs, int) else list(outputs)
    if len(wanted) < 2:
        raise ValueError("captures needs at least two outputs")
    return F.split(
        F.regexp_replace(text, F.lit(DIALECT + pattern), F.lit("\n".join(wanted))), "\n", -1
    )


def matched(parts: Column) -> Column:
    return F.size(parts) > 1


def part(parts: Column, i: int) -> Column:
    """The i-th output of :func:`captures`, NULL beyond the end."""
    return F.get(parts, F.lit(i))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that is computed exactly once per row.

    A filter over a projected column is pushed below the projection and repeats its expression;
    a one-element generator stops that, which matters when the expression is a line regex.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where ``text`` holds one of ``words`` (plain substrings)."""
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def text_map(values: Mapping[str, Column], always: Collection[str] = ()) -> Column:
    """``map<string,string>`` of the values that are not NULL; names in ``always`` never are."""
    if not values:
        return F.create_map().cast("map<string,string>")
    if set(values) <= set(always):
        return F.create_map(*[item for k, v in values.items() for item in (F.lit(k), v)])

    def entry(key: str, value: Column) -> Column:
        pair = F.struct(F.lit(key).alias("key"), value.alias("value"))
        return pair if key in always else F.when(value.isNotNull(), pair)

    return F.map_from_entries(F.array_compact(F.array(*[entry(*kv) for kv in values.items()])))
