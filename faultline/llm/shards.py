"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; sorted by fractional rank, the
sources alternate in proportion, and any cut of that order has the mixture of the whole. Cuts are
made by position, so shards differ by one row at most.

Neither ranking is done by one task: hashes and fractional ranks are spread evenly, so both orders
are cut beforehand into buckets of a few thousand rows whose sizes are summed up as offsets. Only
ids, hashes and sizes are shuffled, never texts.

Defined results: a null text has no bytes and checksum 0; a null source is a stratum of its own; null
ids hash like an empty text; repeated rows are dealt each; further columns are ignored; an empty
table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.staging import staged

#: Rows that one window group ranks, about.
BUCKET_ROWS = 2000


def shards(docs: DataFrame, n_shards: int = 40, seed: str = "shards", overhead: int = 16) -> DataFrame:
    """``doc_id, source, size, text_crc32, position, shard, slot`` of every row."""
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_stratum"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_hash"),
    )
    totals = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_stratum")
    ).groupBy("_stratum").agg(F.count("*").alias("_n"))
    # The first 32 bits of the hash name the bucket, in the order of the hash.
    rows = staged(rows.join(totals, "_stratum").withColumn("_bucket", F.floor(
        F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") * F.ceil(F.col("_n") / BUCKET_ROWS) / F.lit(1 << 32)
    )), "shard-rows")
    total = rows.count()
    sizes = rows.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select("_stratum", "_bucket", _before(Window.partitionBy("_stratum").orderBy("_bucket")))
    order = Window.partitionBy("_stratum", "_bucket").orderBy("_hash", "doc_id", "size", "text_crc32")
    ranked = (
        rows.withColumn("_rank", F.row_number().over(order) - 1)
        .join(before, ["_stratum", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
        .withColumn("_part", F.floor(F.col("_fraction") * -(-total // BUCKET_ROWS)))
        .select("doc_id", "source", "size", "text_crc32", "_stratum", "_rank", "_fraction", "_part")
    )
    ranked = staged(ranked, "shard-ranks")
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per few thousand rows of the corpus: summed up in chunks of parts, then over chunks.
    parts = parts.withColumn("_chunk", F.floor(F.col("_part") / 4096))
    chunks = parts.groupBy("_chunk").agg(F.sum("_size").alias("_size"))
    chunks = chunks.select("_chunk", _before(Window.orderBy("_chunk")).alias("_earlier"))
    offsets = parts.withColumn("_before", _before(Window.partitionBy("_chunk").orderBy("_part"))).join(
        F.broadcast(chunks), "_chunk"
    ).select("_part", (F.col("_before") + F.col("_earlier")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_fraction", "_stratum", "_rank")) - 1
    return (
        ranked.withColumn("_place", place).join(offsets, "_part")
        .withColumn("position", F.col("_place") + F.col("_before"))
        .withColumn("shard", F.expr(f"CAST(position * {n_shards}L DIV {max(total, 1)}L AS int)"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {n_shards - 1}L) DIV {n_shards}L"))
        .select("doc_id", "source", "size", "text_crc32", "position", "shard", "slot")
    )


def _before(window):
    """Rows counted in the earlier buckets."""
    earlier = F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(earlier, F.lit(0)).alias("_before")
