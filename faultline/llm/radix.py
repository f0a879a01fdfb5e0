"""Distributed radix sort: stable counting-sort passes over the digits of a composite key.

A pass reads rows that stand in places 0, 1, 2, ..., counts them by chunk of places and digit, and sums
the counts up in the order of digit, then chunk: that is where each chunk's rows of a digit begin in
the next order. A row's next place is that offset plus its rank among its chunk's rows of the digit.
The least significant digit comes first; as every pass is stable, the last leaves the rows in order.

Only the rows themselves are shuffled, once a pass, by (chunk, digit): a group holds one chunk at
most, whatever the skew of the keys. Counts are combined before their shuffle; a digit's counts are
one row per chunk. Each pass is written to the shared folder, so a lost executor costs one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.staging import dropped, staged

#: Bits of one digit, and of the places in one chunk.
DIGIT_BITS = 11
CHUNK_BITS = 18


def digits(frame: DataFrame, keys: list[str]) -> list[tuple[str, int]]:
    """``(key, shift)`` of the digits in which the keys differ, the least significant first.

    ``keys`` are bigints without nulls, the most significant first, ordered by their bits as they are.
    """
    bounds = frame.agg(*(f(k) for k in keys for f in (F.bit_or, F.bit_and))).head()
    out = []
    for i, key in reversed(list(enumerate(keys))):
        differing = ((bounds[2 * i] or 0) ^ (bounds[2 * i + 1] or 0)) % (1 << 64)
        out += [(key, shift) for shift in range(0, 64, DIGIT_BITS) if differing >> shift & ((1 << DIGIT_BITS) - 1)]
    return out


def ordered(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``rows`` with ``place`` as its gapless place from 0 in the ascending order of ``keys``.

    ``rows`` has a unique bigint in ``place``, any gaps allowed; equal keys keep its order. Nothing
    is read from ``rows`` twice but its keys' bounds, so it should be a written table.
    """
    # One pass at least: it closes the gaps.
    passes = digits(rows, keys) or [(keys[-1], 0)]
    current, own = rows, False
    for key, shift in passes:
        digit = F.shiftrightunsigned(F.col(key), shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
        chunked = current.withColumn("_digit", digit).withColumn("_chunk", F.shiftright(place, CHUNK_BITS))
        counts = chunked.groupBy("_digit", "_chunk").agg(F.count("*").alias("_n"))
        counts = staged(counts, "radix-counts")
        # At most 2^DIGIT_BITS rows.
        totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
        totals = totals.select("_digit", _before(Window.orderBy("_digit")).alias("_first"))
        starts = counts.select(
            "_digit", "_chunk", _before(Window.partitionBy("_digit").orderBy("_chunk")).alias("_start")
        ).join(F.broadcast(totals), "_digit")
        group = Window.partitionBy("_digit", "_chunk").orderBy(place)
        moved = (
            chunked.withColumn("_rank", F.row_number().over(group) - 1)
            .join(starts, ["_digit", "_chunk"])
            .withColumn(place, F.col("_first") + F.col("_start") + F.col("_rank"))
            .select(*rows.columns)
        )
        after = staged(moved, "radix-pass")
        dropped(counts)
        if own:
            dropped(current)
        current, own = after, True
    return current


def _before(window):
    """Rows counted ahead in the window."""
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
