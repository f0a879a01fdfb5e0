"""Row numbers and running values within a group, without putting the group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose order values agree above this many bits form a chunk; with unique order values a
#: chunk has at most 2**18 rows, whatever the size of its group.
CHUNK_BITS = 18
#: Chunks whose numbers agree above this many bits are summed up together before they are scanned.
FAN_BITS = 12


def _chunk(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order), bits)


def before(
    chunks: DataFrame,
    keys: Sequence[str],
    chunk: str,
    carries: dict[str, tuple[str, str]],
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """Add to each chunk's row what the earlier chunks of its group come to.

    ``carries`` names the new columns: ``("sum", column)``, 0 before the first chunk, or ``("max",
    column)``, then NULL. The scan has two levels: blocks of chunks are scanned first, one row each,
    then the chunks within their block, so that neither window grows with the group's rows as such.
    """
    keys = list(keys)
    kinds = {"sum": F.sum, "max": F.max}

    def earlier(name: str, column: str, window) -> Column:
        return kinds[carries[name][0]](column).over(window.rowsBetween(Window.unboundedPreceding, -1))

    blocked = chunks.withColumn("_block", F.shiftright(F.col(chunk), fan_bits))
    blocks = blocked.groupBy(*keys, "_block").agg(
        *[kinds[kind](column).alias(f"_all_{name}") for name, (kind, column) in carries.items()]
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    blocks = blocks.select(
        *keys, "_block", *[earlier(n, f"_all_{n}", over_blocks).alias(f"_far_{n}") for n in carries]
    )
    within = Window.partitionBy(*keys, "_block").orderBy(chunk)
    joined = blocked.join(blocks, [*keys, "_block"])
    out = []
    for name, (kind, column) in carries.items():
        near, far = earlier(name, column, within), F.col(f"_far_{name}")
        if kind == "sum":
            out.append((F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))).alias(name))
        else:
            out.append(F.greatest(near, far).alias(name))
    return joined.select(*chunks.columns, *out)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: dict[str, Column],
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add running sums, from the first row of the group up to and including the current one.

    ``order`` is a bigint, unique within the group. Each chunk is summed on its own; the sum of
    the chunks before it, from :func:`before`, is then added.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", _chunk(order, bits))
    names = list(totals)
    sums = [F.sum(totals[n]).alias(n) for n in names]
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(*sums)
    carried = before(per_chunk, keys, "_chunk", {f"_carry_{n}": ("sum", n) for n in names}).select(
        *keys, "_chunk", *[f"_carry_{n}" for n in names]
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        chunked.join(carried, [*keys, "_chunk"])
        .select(
            *df.columns,
            *[(F.sum(totals[n]).over(inside) + F.col(f"_carry_{n}")).alias(n) for n in names],
        )
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "n", bits: int = CHUNK_BITS
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    return running_totals(df, keys, order, {name: F.lit(1)}, bits)
