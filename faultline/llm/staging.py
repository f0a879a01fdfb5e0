"""Tables written to the shared folder, which cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from faultline.session import shared_folder

#: With it Spark deletes the shuffle files of a query when the query ends, not when the driver's memory is cleaned.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of the rows that go to a Python worker at once; ten thousand texts, Spark's bound, may be any number of bytes.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder; on one machine, where it is unset, a temporary one for this process."""
    if spark.sparkContext.master.startswith("local[") and "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="faultline-")
    return shared_folder(spark, _own.get("folder"))


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as Parquet and read it back; the files go when the session ends.

    The shuffles behind it are not needed any more once it is written, and go at once.
    """
    spark = frame.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{label}-{uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_END, "false")
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_END, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = spark.read.schema(frame.schema).parquet(path)
    table.staged_in = folder
    return table


def dropped(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote for these frames, which nothing reads any more."""
    for frame in frames:
        folder = frame.staged_in
        folder.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def shipped(spark: SparkSession) -> None:
    """Give this package to the executors, once per session, for their Python workers to import; bound what they get at once."""
    spark.conf.set(*_BATCH)
    context = spark.sparkContext
    if _own.get("shipped") == context.applicationId:
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="faultline-")) / "faultline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _own["shipped"] = context.applicationId
