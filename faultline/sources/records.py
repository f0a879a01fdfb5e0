"""Records as JSON text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.formatting import iso_datetime

_READ_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timeZone": "UTC"}


def to_records(df: DataFrame, *keys: str) -> DataFrame:
    """``keys..., record``: every row as a JSON object with ISO times; NULL members are written."""
    members = [
        iso_datetime(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    record = F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
    return df.select(*keys, record.alias("record"))


def from_records(records: DataFrame, schema: T.StructType, column: str = "record") -> DataFrame:
    """Rows of ``schema`` from JSON objects; times are ISO texts.

    Text that is no JSON object gives a row of NULLs.
    """
    read = F.from_json(column, schema, _READ_TIMES)
    return records.select(read.alias("_r")).select("_r.*")


def with_success(results: DataFrame) -> DataFrame:
    """Command results with the computed ``success`` flag their records carry."""
    return results.withColumn("success", F.col("exit_code") == 0)
