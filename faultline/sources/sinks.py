"""Writing of reports and session results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.records import with_success


def write_reports(reports: DataFrame, folder: str, text: str = "report", fmt: str = "parquet") -> None:
    """One report per row. ``text`` output, for few sources, has the reports' lines only, in one folder
    per source; its name is the source's, URL-encoded, so that no two sources share one."""
    if fmt == "text":
        named = reports.select(
            F.url_encode("source").alias("source"), F.col(text).alias("value")
        )
        named.write.mode("overwrite").partitionBy("source").text(folder)
    else:
        reports.write.mode("overwrite").format(fmt).save(folder)


def write_session_results(results: DataFrame, folder: str) -> None:
    """Command results as JSON lines."""
    with_success(results).write.mode("overwrite").json(folder)


def write_entries(entries: DataFrame, folder: str, rebalance: bool = False) -> None:
    """Parsed entries as parquet, by format and day, so that later queries read what they need.

    Log files are mostly in time order, so a task meets few days and needs no shuffle. For others,
    ``rebalance`` brings each day together in files of even size.
    """
    dated = entries.withColumn("day", F.to_date("ts"))
    if rebalance:
        dated = dated.hint("rebalance", "format", "day")
    dated.write.mode("append").partitionBy("format", "day").parquet(folder)
