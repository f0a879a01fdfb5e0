"""The facts of sessions on disk, brought up to date batch by batch.

A session's facts lie in the bucket of its hash. Every merge writes the buckets its batch touches as a
new version, ``version=N/bucket=B``, and a version counts once its ``_SUCCESS`` is there; readers take
the newest version of every bucket. So a merge that was lost half way leaves the store as it was.

A merge is a fold of folds: it may be repeated, and batches may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.memory import fold_facts, upsert_facts

#: Folders that sessions are dealt to; a store keeps the number it was begun with.
FACT_BUCKETS = 64


class FactStore:
    """Facts (``session_id, fact``, what is stated of them, ``position, updated``) below ``folder``.

    ``stated`` names the columns that a writing states, with their types, as in ``"source string"``.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, stated: str, buckets: int = FACT_BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.base = folder.rstrip("/")
        self.folder = f"{self.base}/of={buckets}"
        self.schema = spark.createDataFrame(
            [], f"session_id string, fact string, {stated}, position bigint, updated bigint"
        ).schema

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path, key: str) -> list[int]:
        files = self._files()
        if not files.exists(path):
            return []
        names = [s.getPath().getName().split("=", 1) for s in files.listStatus(path) if s.isDirectory()]
        return sorted(int(n[1]) for n in names if n[0] == key)

    def _versions(self) -> list[int]:
        """The whole versions, the oldest first."""
        others = [n for n in self._children(self._path().getParent(), "of") if n != self.buckets]
        if others:
            raise ValueError(f"The store has {others[0]} buckets, not {self.buckets}")
        files = self._files()
        return [v for v in self._children(self._path(), "version") if files.exists(self._path(f"version={v}", "_SUCCESS"))]

    def _newest(self) -> dict[int, int]:
        """The version that holds each bucket."""
        return {b: v for v in self._versions() for b in self._children(self._path(f"version={v}"), "bucket")}

    def _read(self, buckets: dict[int, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        paths = [self._path(f"version={v}", f"bucket={b}").toString() for b, v in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self, session):
        return F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int")

    def facts(self, session: str | None = None) -> DataFrame:
        """All facts as of the last merge, or those of one session, for which one bucket is read."""
        newest = self._newest()
        if session is None:
            return self._read(newest)
        number = self.spark.range(1).select(self._bucket(F.lit(session))).first()[0]
        return self._read({b: v for b, v in newest.items() if b == number}).filter(F.col("session_id") == session)

    def merge(self, writings: DataFrame) -> list[int]:
        """Fold a batch of writings (``session_id, seq, fact`` and the stated columns) into the store.

        Gives the buckets that were rewritten; the others are not read.
        """
        newest, versions = self._newest(), self._children(self._path(), "version")
        batch = upsert_facts(writings).select(*self.schema.names)
        # As many numbers as there are buckets, at most.
        touched = sorted(r[0] for r in writings.select(self._bucket(F.col("session_id"))).distinct().collect())
        if not touched:
            return []
        old = self._read({b: v for b, v in newest.items() if b in touched})
        (
            fold_facts(old.unionByName(batch)).select(*self.schema.names, self._bucket(F.col("session_id")).alias("bucket"))
            .hint("rebalance", "bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(self._path(f"version={max(versions, default=0) + 1}").toString())
        )
        return touched

    def tidy(self) -> int:
        """Delete the buckets that newer versions replace, when nothing reads them any more; gives their number."""
        newest, gone = self._newest(), 0
        for version in self._versions():
            for bucket in self._children(self._path(f"version={version}"), "bucket"):
                if newest[bucket] != version:
                    gone += self._files().delete(self._path(f"version={version}", f"bucket={bucket}"), True)
        return gone
