"""Importance resampling towards a target distribution, with an exact distributed ranking.

Every text is a bag of runs of one to three words, hashed into buckets. A bucket's gain says how much
more frequent it is in the target texts than in the documents; a document's weight is the sum of its
gains, an array lookup. With one Gumbel number per document, fixed by its id, the highest scores are
a draw without replacement in proportion to the exponential of the weights.

The documents are read twice: for the counts of the buckets, which tasks add up before the shuffle,
and for the weights. What is broadcast is one number per bucket, whatever the input. The rows that can
be drawn, known from a histogram of all scores, are then ranked by the radix sort of ``radix``.

Defined results: null and empty texts have no features, weight 0, and too few words to be drawn; a
null id draws the number of an empty id and comes after other ids of its score; rows of one id and
score are ranked in the order of the table; repeated rows count each; further columns are ignored; an
empty table gives an empty result; no target texts leave all gains to the documents' own counts.
A very long text is a block of its own: memory follows the longest text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import crc, words
from faultline.llm.radix import ordered
from faultline.llm.staging import dropped, staged

#: Buckets that features are hashed into; one gain each is broadcast.
BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
#: Bars of the histogram that bounds the rows worth ranking.
BARS = 1 << 16

SCORED = ("doc_id bigint, n_words bigint, n_features bigint, weight bigint")
_SCORED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight")])
_COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, words.Words]]:
    """For runs of one word, then two, then three: first words and buckets, and the words themselves."""
    found = words.Words(data, offsets)
    lengths = found.ends - found.starts
    own = crc.spans(found.data, found.starts, found.ends)
    # Each word behind one space.
    spaced = crc.joined(np.full(len(own), zlib.crc32(b" "), np.uint32), own, lengths)
    end = np.repeat(found.offsets[1:], np.diff(found.offsets))
    first, run = np.arange(len(own)), own
    for size in range(1, RUN + 1):
        if size > 1:
            inside = first + size - 1 < end[first]
            first, run = first[inside], run[inside]
            last = first + size - 1
            run = crc.joined(run, spaced[last], lengths[last] + 1)
        yield first, (run % np.uint32(BUCKETS)).astype(np.int64), found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in words.blocks(batch.column(0)):
            for _, bucket, _ in features(data, offsets):
                total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], schema=_COUNTED)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    counted = texts.select("text").mapInArrow(_counted, "bucket int, n bigint")
    # At most BUCKETS rows.
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the source."""
    over, under = float(target.sum() + BUCKETS), float(source.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1) * under / ((s + 1) * over)))
        for t, s in zip(target.tolist(), source.tolist(), strict=True)
    ], np.int64)


def _weighed(gain, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = gain.value
    for batch in batches:
        ids = batch.column(0)
        for first, last, data, offsets in words.blocks(batch.column(1)):
            n = last - first
            runs, weight, bounds = np.zeros(n, np.int64), np.zeros(n, np.int64), None
            for start, bucket, found in features(data, offsets):
                bounds = found.offsets
                at = np.searchsorted(start, bounds)
                sums = np.concatenate([[0], np.cumsum(table[bucket])])
                runs += np.diff(at)
                weight += sums[at[1:]] - sums[at[:-1]]
            yield pa.record_batch(
                [ids.slice(first, n), pa.array(np.diff(bounds)), pa.array(runs), pa.array(weight)], schema=_SCORED
            )


def scored(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``."""
    gain = gains(bucket_counts(target), bucket_counts(docs))
    given = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(partial(_weighed, given), SCORED)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """All rows' ``doc_id, n_words, n_features, weight, score`` and ``rank`` where they are drawn.

    Of the rows of at least ``least_words`` words, ``percent`` of a hundred are drawn, the highest
    scores first and ties by the smaller id.
    """
    rows = scored(docs, target, seed).withColumn("_place", F.monotonically_increasing_id())
    rows = staged(rows, "resample-scores")
    allowed = rows.where(F.col("n_words") >= least_words)
    n, low, high = allowed.agg(F.count("*"), F.min("score"), F.max("score")).head()
    wanted = n * percent // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).drop("_place")
    # Rows below the bar in which the last drawn row stands need no exact rank.
    width = (high - low) // BARS + 1
    bar = F.floor((F.lit(high) - F.col("score")) / width)
    bars = sorted(allowed.groupBy(bar.alias("bar")).count().collect())
    reached, last = 0, 0
    for last, size in bars:
        reached += size
        if reached >= wanted:
            break
    able = allowed.where(bar <= last).select(
        (F.lit(high) - F.col("score")).alias("_below"),
        F.col("doc_id").isNull().cast("bigint").alias("_without"),
        # The order of signed numbers, as that of their bits.
        F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0)).alias("_id"),
        "_place", F.col("_place").alias("_row"),
    )
    able = staged(able, "resample-able")
    places = ordered(able, ["_below", "_without", "_id"], "_place")
    drawn = places.where(F.col("_place") < wanted).select(
        F.col("_row").alias("_place"), (F.col("_place") + 1).alias("rank")
    )
    dropped(able)
    return rows.join(drawn, "_place", "left").drop("_place")
