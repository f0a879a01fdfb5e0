"""Statistics of parsed entries, one result per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.formatting import fixed, level_bar, round_exact
from faultline.functions.text import bind

ERROR_TYPE_CHARS = 50
TOP_ERRORS = 10
SAMPLE_ERRORS = 100


def _error_type() -> Column:
    return F.when(
        F.col("level") == "ERROR", F.substring("message", 1, ERROR_TYPE_CHARS)
    )


def grouped_entries(entries: DataFrame) -> DataFrame:
    """``file, level, error_type, g``: the one pass over the entries that all statistics share.

    Only errors keep their type, so the rest folds into a row per level before the shuffle. The
    measures are bound together as ``g``: statistics that use only some of them, or only the
    errors, then still come from the same shuffle instead of parsing the lines once more.
    """
    has_address = F.col("ip_address") != ""
    measures = entries.groupBy("file", "level", _error_type().alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.min("line_id").alias("first_line"),
        F.min(F.when(has_address, F.col("line_id"))).alias("first_address"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
    )
    together = F.struct("count", "errors", "first_line", "first_address", "ts_min", "ts_max")
    return bind(measures, "g", together).select("file", "level", "error_type", "g")


def level_counts(grouped: DataFrame) -> DataFrame:
    """``file, level, count, first_line, first_address, ts_min, ts_max``."""
    return grouped.groupBy("file", "level").agg(
        F.sum("g.count").alias("count"),
        F.min("g.first_line").alias("first_line"),
        F.min("g.first_address").alias("first_address"),
        F.min("g.ts_min").alias("ts_min"),
        F.max("g.ts_max").alias("ts_max"),
    )


def totals(levels: DataFrame) -> DataFrame:
    """``file, total_lines, error_lines, warning_lines, error_rate, level_counts, ts_min, ts_max,
    file_format``.

    Only ERROR counts as an error line; FATAL does not. The format is the label reports show:
    Nginx when the first entry has an address, else Syslog.
    """
    def of(level: str) -> Column:
        return F.sum(F.when(F.col("level") == level, F.col("count")).otherwise(0))

    sums = levels.groupBy("file").agg(
        F.sum("count").alias("total_lines"),
        of("ERROR").alias("error_lines"),
        of("WARN").alias("warning_lines"),
        F.min("ts_min").alias("ts_min"),
        F.max("ts_max").alias("ts_max"),
        (F.min("first_address") == F.min("first_line")).alias("_addressed"),
        F.array_sort(
            F.collect_list(F.struct("first_line", F.col("level").alias("key"),
                                    F.col("count").alias("value")))
        ).alias("_levels"),
    )
    # The map keeps the order in which the levels first appear.
    ordered = F.transform("_levels", lambda x: F.struct(x["key"], x["value"]))
    return sums.select(
        "file", "total_lines", "error_lines", "warning_lines",
        round_exact(F.col("error_lines") / F.col("total_lines") * 100, 2).alias("error_rate"),
        F.map_from_entries(ordered).alias("level_counts"),
        "ts_min", "ts_max",
        F.when(F.col("_addressed"), "Nginx").otherwise("Syslog").alias("file_format"),
    )


def top_error_types(grouped: DataFrame, count: int = TOP_ERRORS) -> DataFrame:
    """``file, rank, error_type, count``: the most frequent error texts; ties by first line."""
    types = grouped.filter(F.col("g.errors") > 0).select(
        "file", "error_type", F.col("g.count").alias("count"),
        F.col("g.first_line").alias("first_line"),
    )
    order = Window.partitionBy("file").orderBy(F.desc("count"), "first_line")
    return (
        types.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= count)
        .select("file", "rank", "error_type", "count")
    )


def log_statistics(entries: DataFrame) -> DataFrame:
    """One row per file that has entries, as ``source``: counts, error rate, ``level_counts`` (map in
    order of first appearance), ``error_types`` (array, most frequent first), time range, label."""
    grouped = grouped_entries(entries)
    top = top_error_types(grouped).groupBy(F.col("file").alias("_file")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "error_type", "count"))).alias("_top")
    )
    types = F.transform("_top", lambda x: F.struct(x["error_type"], x["count"]))
    return (
        # An ordinary equality would filter one side for NULL, and its shuffle would not be shared.
        totals(level_counts(grouped)).join(top, F.col("file").eqNullSafe(F.col("_file")), "left")
        .select(
            F.col("file").alias("source"),
            "total_lines", "error_lines", "warning_lines", "error_rate", "level_counts",
            F.coalesce(
                types, F.array().cast("array<struct<error_type:string,count:bigint>>")
            ).alias("error_types"),
            "ts_min", "ts_max", "file_format",
        )
    )


def level_shares(stats: DataFrame) -> DataFrame:
    """``source, position, level, count, percentage, bar`` with one block per five percent."""
    rows = stats.select(
        "source", "total_lines",
        F.posexplode(F.map_entries("level_counts")).alias("position", "_level"),
    )
    share = F.col("_level.value") / F.col("total_lines") * 100
    return rows.select(
        "source", "position", F.col("_level.key").alias("level"),
        F.col("_level.value").alias("count"),
        F.concat(fixed(share, 1), F.lit("%")).alias("percentage"),
        level_bar(share).alias("bar"),
    )


def error_sample(entries: DataFrame, count: int = SAMPLE_ERRORS) -> DataFrame:
    """``file, n, ts, message``: the first ERROR or FATAL entries of each file, in file order."""
    order = Window.partitionBy("file").orderBy("line_id")
    return (
        entries.filter(F.col("level").isin("ERROR", "FATAL"))
        .select("file", "line_id", "ts", "message")
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= count)
        .select("file", "n", "ts", "message")
    )
