"""Connected components of any number of edges, by alternating star contractions.

Every round hangs each node's larger neighbours, and then its smaller ones, on the smallest node it
knows; a few rounds leave one star per component. All steps are aggregations and joins of pairs of
ids, and each is written to the shared folder, so a hub with very many neighbours is split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.staging import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``edges`` (``a, b``), with the smallest id of its component as root.

    Loops and repeated edges do no harm; null ends are left out.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = staged(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(),
            "large-stars",
        )
        dropped(least)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        before, now = now, staged(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(),
            "small-stars",
        )
        # Only the newest stars are read from here on.
        dropped(least, large, before)
        after = _mark(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """What tells a set of edges from the one of the round before."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first())
