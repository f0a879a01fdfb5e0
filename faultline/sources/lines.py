"""Log files as one row per line."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default of the optional size guard: 100 MB.
MAX_LOG_SIZE = 100 * 1024 * 1024

_MIB = 1024 * 1024
_COUNTER_BITS = 33


def _line_id(block_start: Column) -> Column:
    """Position of a line in its file: the block it starts in, then its number in that task.

    Blocks are at least 1 MiB apart, so the block's start in MiB is unique; the row counter takes
    the low 33 bits of Spark's generated id.
    """
    counter = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _COUNTER_BITS) - 1))
    return F.shiftleft(F.shiftright(block_start, 20), _COUNTER_BITS).bitwiseOR(counter)


def _bytes(setting: str) -> int:
    units = {"b": 1, "k": 1024, "m": _MIB, "g": 1024 * _MIB}
    text = setting.strip().lower().removesuffix("b") or "0"
    if text[-1] in units:
        return int(text[:-1]) * units[text[-1]]
    return int(text)


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    max_size: int | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Lines of all files under ``paths`` with ``file, line_id, file_size, block_start, modified``.

    ``line_id`` is unique and increasing within a file. ``max_size`` leaves out larger files; the
    default keeps all. Bytes that are not UTF-8 read
    as U+FFFD. Compressed files cannot be split; ``repartition`` them before heavy work.
    """
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if _bytes(spark.conf.get(key)) < _MIB:
            raise ValueError(f"{key} must be at least 1 MiB, so that blocks can be told apart")
    reader = spark.read
    if encoding:
        reader = reader.option("encoding", encoding)
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = reader.text(paths)
    meta = F.col("_metadata")
    if max_size is not None:
        # Before the line numbers, so that the files themselves are left out of the scan.
        raw = raw.filter(meta["file_size"] <= max_size)
    return raw.select(
        meta["file_path"].alias("file"),
        _line_id(meta["file_block_start"]).alias("line_id"),
        "value",
        meta["file_size"].alias("file_size"),
        meta["file_block_start"].alias("block_start"),
        meta["file_modification_time"].alias("modified"),
    )


def read_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, content``: whole files in one row each, for small files only."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def file_year(modified: Column | str = "modified") -> Column:
    """The year for clocks without one, from the file's modification time."""
    return F.year(modified)


def replaced_bytes(lines: DataFrame) -> DataFrame:
    """Per file, how many lines hold undecodable bytes or characters that replaced such bytes."""
    return lines.groupBy("file").agg(
        F.count_if(~F.is_valid_utf8("value") | F.col("value").contains("�")).alias(
            "undecodable_lines"
        )
    )


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, file_size`` of all files, from the listing; no content is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("file_size")
    )


def read_heads(spark: SparkSession, paths: str | Sequence[str], count: int = 20) -> DataFrame:
    """The first ``count`` lines of each file, without scanning the rest of it.

    The listing comes from Spark (no content is read for it); each task then opens its files and
    stops after ``count`` lines. The files are opened by pyarrow, which knows local, HDFS, S3 and
    GCS paths; for other stores take the heads from the scanned lines.
    """
    files = list_files(spark, paths).select("file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        from itertools import islice

        from pyarrow import fs

        for batch in batches:
            for uri in batch["file"]:
                system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
                with system.open_input_stream(path, compression="detect") as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
                    found = [line.rstrip("\n") for line in islice(text, count)]
                yield pd.DataFrame(
                    {"file": uri, "line_id": range(len(found)), "value": found}
                )

    return files.mapInPandas(read, "file string, line_id bigint, value string")
