"""Events that span several physical lines, as two related tables: heads, and lines in their order.

An event may have any number of lines, so none is ever put together in one row or one task: the lines
keep their rows and learn the number of their event and their place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.pyregex import translate
from faultline.functions.text import DIALECT
from faultline.operators.custom import ParserConfig
from faultline.operators.ordered import CHUNK_BITS, FAN_BITS, before


def event_lines(
    lines: DataFrame, start_pattern: str, bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS
) -> DataFrame:
    """``file, event_no, line_no, line_id, value``: every line with its event and its place there.

    A line that matches ``start_pattern`` at its beginning starts an event; lines before the first
    start form event 0. ``line_no`` counts from 0. The result does not depend on the sizes of the
    chunks in which the lines are numbered.
    """
    start = F.col("_start")
    chunk = Window.partitionBy("file", "_chunk").orderBy("line_id")
    so_far = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # A file is cut into chunks of lines; each is numbered on its own. Chunks are dealt to a fixed number
    # of tasks: put together by their compressed size, sorted lines would take many times that in memory.
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.select(
        "file", "line_id", "value",
        F.shiftright("line_id", bits).alias("_chunk"),
        F.col("value").rlike(f"{DIALECT}^(?:{translate(start_pattern)})").alias("_start"),
    ).repartition(tasks, "file", "_chunk").withColumn("_k", F.row_number().over(chunk).cast("bigint"))
    # One row per chunk tells what lies before it: lines, starts, and where the last start was.
    chunks = lines.groupBy("file", "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(start).alias("_starts"),
        F.max(F.when(start, F.col("_k"))).alias("_last_k"),
    )
    counted = before(
        chunks, ["file"], "_chunk", {"_lines_before": ("sum", "_rows"), "_starts_before": ("sum", "_starts")},
        fan_bits,
    ).withColumn("_last", F.col("_lines_before") + F.col("_last_k"))
    carried = before(counted, ["file"], "_chunk", {"_open_since": ("max", "_last")}, fan_bits).select(
        "file", "_chunk", "_lines_before", "_starts_before", "_open_since"
    )
    number = F.col("_lines_before") + F.col("_k")
    first = F.coalesce(F.max(F.when(start, number)).over(so_far), "_open_since", F.lit(1))
    return lines.join(carried, ["file", "_chunk"]).select(
        "file",
        (F.count_if(start).over(so_far) + F.col("_starts_before")).alias("event_no"),
        (number - first).alias("line_no"), "line_id", "value",
    )


def event_heads(placed: DataFrame) -> DataFrame:
    """``file, event_no, line_id, lines, value``: the first line of each event and how many it has."""
    head = F.col("line_no") == 0
    return placed.groupBy("file", "event_no").agg(
        F.min("line_id").alias("line_id"),
        F.count(F.lit(1)).alias("lines"),
        F.max(F.when(head, F.col("value"))).alias("value"),
    )


def multiline_lines(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """Lines as the format sees them: the heads of events when it is a multi-line one.

    The result has the usual line columns, ready for parsing: an event is one entry, or one line in
    quarantine, however long it is. Its lines are those of :func:`event_lines` by ``line_id``.
    """
    if not (config.multiline and config.multiline_pattern):
        return lines
    return event_heads(event_lines(lines, config.multiline_pattern)).select(
        "file", "line_id", "value", "event_no", "lines"
    )
