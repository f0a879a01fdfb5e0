"""Display formats used by reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(value: Column, digits: int) -> Column:
    """``value * 10**digits`` as a whole double, rounded by the exact binary value.

    Near a tie the product alone cannot tell on which side the binary value lies, so its rounding
    error is recovered by splitting the value in two halves of 26 bits (a Dekker product).
    """
    value = value.cast("double")
    twice = F.lit(2.0 * 10**digits)
    nearest = F.rint(value * twice)
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    rest = (high * twice - nearest) + (value - high) * twice
    odd = nearest % 2 != 0
    half_even = F.rint(nearest / 2)
    tie = (
        F.when(rest > 0, (nearest + 1) / 2).when(rest < 0, (nearest - 1) / 2).otherwise(half_even)
    )
    return F.when(odd & (F.abs(rest) < 1e-3), tie).otherwise(F.rint(value * F.lit(10.0**digits)))


def round_exact(value: Column, digits: int) -> Column:
    """Python's ``round(value, digits)`` for doubles."""
    return _scaled(value, digits) / F.lit(10.0**digits)


def fixed(value: Column, digits: int) -> Column:
    """Python's ``f"{value:.{digits}f}"`` for doubles."""
    whole = _scaled(value, digits).cast("decimal(30,0)")
    if digits:
        whole = whole * F.lit(Decimal(1).scaleb(-digits))
    return whole.cast("string")


def grouped(count: Column) -> Column:
    """``f"{count:,}"``."""
    return F.format_number(count, 0)


def percent(share: Column) -> Column:
    """``f"{share:.0%}"``."""
    return F.concat(fixed(share * 100, 0), F.lit("%"))


def format_size(size: Column) -> Column:
    """Bytes with one decimal, in units of 1024 up to TB."""
    size = size.cast("double")
    units = ["B", "KB", "MB", "GB"]
    text = F.when(size < 1024.0, F.concat(fixed(size, 1), F.lit(" B")))
    for power, unit in enumerate(units[1:], 1):
        text = text.when(
            size < 1024.0 ** (power + 1),
            F.concat(fixed(size / 1024.0**power, 1), F.lit(f" {unit}")),
        )
    return text.when(
        size.isNotNull(), F.concat(fixed(size / 1024.0**4, 1), F.lit(" TB"))
    )


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    seconds = seconds.cast("double")
    return (
        F.when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("秒")))
        .when(seconds < 3600, F.concat(fixed(seconds / 60, 1), F.lit("分钟")))
        .when(seconds.isNotNull(), F.concat(fixed(seconds / 3600, 1), F.lit("小时")))
    )


def risk_label(risk: Column) -> Column:
    """Icon, level and meaning of a risk level; anything but P0 and P1 is a minor problem."""
    icon = F.when(risk == "P0", "🔴").when(risk == "P1", "🟡").otherwise("🟢")
    meaning = (
        F.when(risk == "P0", "服务完全不可用")
        .when(risk == "P1", "部分功能受影响")
        .otherwise("偶发问题")
    )
    return F.concat(icon, F.lit(" **"), risk, F.lit("** - "), meaning)


def level_bar(percentage: Column) -> Column:
    """One block per full five percent."""
    return F.repeat(F.lit("█"), F.floor(percentage / 5).cast("int"))


def python_datetime(ts: Column) -> Column:
    """``str(datetime)``: seconds, and microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def iso_datetime(ts: Column | str) -> Column:
    """``datetime.isoformat()``."""
    fraction = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def plain_number(value: Column) -> Column:
    """A double as a text without an exponent from 0.0001 up to 10^16, and beyond with one."""
    digits = F.rtrim(value.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(value)
    return F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(value.cast("string"))
