"""Rows by their content: what decisions about rows are joined back by.

Ids may repeat or be null, so a row is known by its id and a hash of its id and text. Rows that agree
in both are the same row, and any decision holds for all of them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.staging import dropped, staged


def own_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, own_key`` of every row."""
    return docs.select("doc_id", "text", own_key(docs).alias("own_key"))


def _same(docs: DataFrame, rows: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(rows["doc_id"]) & (own_key(docs) == rows["own_key"])


def without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not among ``losers`` (``doc_id, own_key``), which are written first,
    so that Spark knows their size when it chooses how to join."""
    lost = staged(losers.select("doc_id", "own_key").distinct(), "dropped-rows")
    return docs.join(lost, _same(docs, lost), "left_anti")


def one_per_group(docs: DataFrame, found: DataFrame, group: list[str], best) -> DataFrame:
    """The rows of ``docs`` but one of every group of ``found`` (``doc_id, own_key`` and ``group``).

    The row of the ``best`` id stays (``F.min`` or ``F.max``; a null id only where all are null), of
    those the one of the smallest key, once. Rows that are not in ``found`` stay.
    """
    groups = staged(found.groupBy(*group).agg(
        best("doc_id").alias("keep_id"), F.count("*").alias("group_rows")
    ).where("group_rows > 1"), "groups")
    members = staged(found.join(groups, group), "group-members")
    first = members.where("doc_id <=> keep_id").groupBy(*group).agg(F.min("own_key").alias("keep_key"))
    marked = staged(members.join(first, group).select(
        "doc_id", "own_key", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_key") == F.col("keep_key"))).alias("stays")
    ), "marked-rows")
    dropped(groups, members)
    out = without(docs, marked.where("NOT stays"))
    repeated = staged(marked.where("stays").groupBy("doc_id", "own_key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    dropped(marked)
    if repeated.isEmpty():
        return out
    # A name that no table has: the rows carry all their columns.
    name = f"key_{uuid4().hex}"
    once = out.join(repeated, _same(out, repeated), "left_semi").withColumn(name, own_key(out)).dropDuplicates(["doc_id", name]).drop(name)
    return out.join(repeated, _same(out, repeated), "left_anti").unionByName(once)
