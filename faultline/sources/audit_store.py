"""The audit table on disk: JSON lines by day, an index by id, and exports."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.formatting import iso_datetime
from faultline.operators.audit import filter_audit, query_audit
from faultline.schema import AUDIT

#: Folders that ids are dealt to in the index.
ID_BUCKETS = 64
#: Ids that the filter of one file of the index is made for, and its rate of false finds.
BLOOM_IDS, BLOOM_RATE = 1_000_000, 0.001
#: Days that the first step of a search for the newest entries reads; each further step reads twice as many.
FIRST_DAYS = 1

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def append_audit(entries: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append entries as JSON lines, one folder per day of the entries and batch
    (``date=YYYY-MM-DD/batch=...``).

    Each day's entries are brought together first, in files of even size. A batch that is appended
    again, as after a lost driver, takes the place of what it wrote before; one without a name is new.
    """
    (
        entries.select(*AUDIT.fieldNames())
        .withColumn("date", F.to_date("timestamp"))
        .withColumn("batch", F.lit(batch or uuid4().hex))
        .hint("rebalance", "date")
        .withColumn("timestamp", iso_datetime("timestamp"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch")
        .option("ignoreNullFields", "false")
        .json(folder)
    )


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Entries written by :func:`append_audit`; time bounds prune folders by ``date``."""
    fields = ", ".join(
        f"`{f.name}` {'string' if f.name == 'timestamp' else f.dataType.simpleString()}"
        for f in AUDIT.fields
    )
    raw = spark.read.schema(f"{fields}, `date` date, `batch` string").json(folder)
    return raw.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def _days(spark: SparkSession, folder: str) -> list[date | None]:
    """The days that have a folder, the newest first; None, of entries without a time, comes last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName().split("=", 1) for s in listed if s.isDirectory()]
    values = [v[1] for v in names if v[0] == "date"]
    days = sorted((date.fromisoformat(v) for v in values if v != _NO_DAY), reverse=True)
    return days + [None] * (_NO_DAY in values)


def newest_audit(
    spark: SparkSession, folder: str, limit: int, start=None, end=None,
    action: str | None = None, result: str | None = None, host: str | None = None,
) -> DataFrame:
    """Stored entries that meet the conditions, from as many of the newest days as hold ``limit`` of them.

    The days are known from the listing and read from the newest on, twice as many at each step, until
    they hold enough. Older folders are not read at all.
    """
    entries = filter_audit(read_audit(spark, folder), start, end, action, result, host)
    days, taken, found = _days(spark, folder), 0, 0
    step = FIRST_DAYS
    while taken < len(days) and found < limit:
        some = days[taken:taken + step]
        found += entries.filter(_of_days(some)).limit(limit - found).count()
        taken, step = taken + len(some), step * 2
    return entries.filter(_of_days(days[:taken]))


def _of_days(days: list[date | None]) -> Column:
    """Days in a row, or those without one."""
    known = [d for d in days if d is not None]
    chosen = F.lit(False)
    if known:
        chosen = (F.col("date") >= F.lit(min(known))) & (F.col("date") <= F.lit(max(known)))
    return chosen | F.col("date").isNull() if None in days else chosen


def _bucket(entry_id: Column) -> Column:
    return F.pmod(F.xxhash64(entry_id), F.lit(ID_BUCKETS)).cast("int")


def index_audit(entries: DataFrame, folder: str, batch: str | None = None, bloom: bool = True) -> None:
    """Append entries to an index by id: columns, dealt to folders by the id's hash, with a Bloom filter.

    A batch that is appended again takes the place of what it wrote before.
    """
    written = (
        entries.select(*AUDIT.fieldNames())
        .withColumn("bucket", _bucket(F.col("id"))).withColumn("batch", F.lit(batch or uuid4().hex))
        .hint("rebalance", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch")
    )
    if bloom:
        written = (
            written.option("parquet.bloom.filter.enabled#id", "true")
            .option("parquet.bloom.filter.expected.ndv#id", str(BLOOM_IDS))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.fpp#id", str(BLOOM_RATE))
        )
    written.parquet(folder)


def lookup_audit(spark: SparkSession, folder: str, entry_id: str) -> DataFrame:
    """The entries of one id from the index: one folder is read, and there what the filters let through."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in AUDIT.fields)
    stored = spark.read.schema(f"{fields}, `bucket` int, `batch` string").parquet(folder)
    wanted = F.lit(entry_id)
    return stored.filter((F.col("bucket") == _bucket(wanted)) & (F.col("id") == wanted)).select(*AUDIT.fieldNames())


def audit_export_rows(
    entries: DataFrame, start=None, end=None, limit: int | None = None
) -> DataFrame:
    """What an export holds, newest first, with ISO times and details as a JSON text; all matching
    entries unless a ``limit`` is given."""
    found = query_audit(entries, start=start, end=end, limit=limit)
    details = F.coalesce(F.to_json("details"), F.lit("{}"))
    return found.select(
        *[
            iso_datetime("timestamp").alias(name) if name == "timestamp"
            else details.alias(name) if name == "details"
            else F.col(name)
            for name in AUDIT.fieldNames()
        ]
    )


def export_audit(
    entries: DataFrame, folder: str, fmt: str = "json", start=None, end=None,
    limit: int | None = None,
) -> None:
    """Write an export, newest first: JSON objects, or CSV with a header."""
    if fmt == "json":
        found = query_audit(entries, start=start, end=end, limit=limit)
        rows = found.select(*AUDIT.fieldNames()).withColumn("timestamp", iso_datetime("timestamp"))
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
    elif fmt == "csv":
        rows = audit_export_rows(entries, start, end, limit)
        (
            rows.write.mode("overwrite").option("header", True)
            .option("quote", '"').option("escape", '"').option("emptyValue", "")
            .csv(folder)
        )
    else:
        raise ValueError(f"Unsupported format: {fmt}")
