"""The same parsers over arriving files. Parsing keeps no state, so nothing else changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.lineformat import LineFormat, ParsedLines, parse_as


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of files that appear under ``path``.

    A stream has no lasting line numbers; ``line_id`` is the start of the line's block.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("line_id"),
        "value",
    )


def parse_stream(lines: DataFrame, fmt: LineFormat) -> ParsedLines:
    return parse_as(lines, fmt)


def write_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append all rows available now to parquet, exactly once across restarts."""
    return (
        rows.writeStream.format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
