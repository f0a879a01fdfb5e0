"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes says so, so that equal texts have equal
cuts. A chunk's content moves once, to be compared with all others of its digest: a digest that two
contents share gets a rank by content, so identifiers are verified, not trusted. Documents are then
compared as ordered lists of identifiers, 16 bytes for about a thousand; their texts stay in place.

Defined results: null counts as empty; an empty text has an empty recipe and equals other empty
texts; rows that repeat a ``doc_id`` each have a row in the result; in ``classes`` every row of the
id that stays is kept, so all rows of a group whose ids are all null, while ``deduplicated`` leaves
one row of each text, known by id and text; further columns are ignored; an empty table gives an
empty result. Texts of any length are cut a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.rows import one_per_group, own_key
from faultline.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 48
#: Chunks hold 256 to 8192 bytes, about 1 KB on average.
SHORTEST, LONGEST, CUT_BITS = 256, 8192, 10

Digest = Callable[[bytes], bytes]


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_of(chunk: bytes, size: int = 16) -> bytes:
    """The first ``size`` bytes of a 128-bit hash, with zeros behind them; fewer than 16 are for tests."""
    return xxhash.xxh3_128_digest(chunk)[:size].ljust(16, b"\0")


def cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For every text of a block the ends of its chunks."""
    if len(data) > WINDOW:
        prefix = words.prefix_hash(data)
        rolling = (prefix[WINDOW:] - prefix[:-WINDOW]) * words._power("down", len(data))[:len(data) - WINDOW + 1]
        rolling *= np.uint64(0xFF51AFD7ED558CCD)
        places = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    else:
        places = np.zeros(0, np.int64)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, last = [], start
        low, high = np.searchsorted(places, (start + SHORTEST, end))
        for place in places[low:high].tolist():
            while place - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if place - last >= SHORTEST:
                ends.append(place)
                last = place
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end > last:
            ends.append(end)
        yield ends


@words.tidy
def _recipes(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            raw, lists, counts = data.tobytes(), [], []
            for start, ends in zip(offsets.tolist(), cuts(data, offsets), strict=False):
                lists.append(b"".join(digest(raw[a:b]) for a, b in zip([start, *ends], ends, strict=False)))
                counts.append(len(ends))
            part = batch.slice(first, last - first)
            yield pa.record_batch({
                "doc_id": part["doc_id"], "own_key": part["own_key"], "text_sha256": part["text_sha256"],
                "n_bytes": pa.array(np.diff(offsets)), "n_chunks": pa.array(counts, pa.int64()),
                "recipe": pa.array(lists, pa.binary()),
            })


@words.tidy
def _contents(batches: Iterator[pa.RecordBatch], digest: Digest, places: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in words.blocks(batch["text"]):
            raw, found, seen = data.tobytes(), [], set()
            for i, (start, ends) in enumerate(zip(offsets.tolist(), cuts(data, offsets), strict=False)):
                for pos, (a, b) in enumerate(zip([start, *ends], ends, strict=False)):
                    chunk = raw[a:b]
                    if places:
                        found.append((batch["row_key"][first + i].as_py(), pos, digest(chunk), chunk))
                    elif chunk not in seen:
                        seen.add(chunk)
                        found.append((digest(chunk), chunk))
            columns = list(zip(*found, strict=True)) or [()] * (4 if places else 2)
            kinds = [pa.binary(), pa.binary()]
            names = ["digest", "chunk"]
            if places:
                kinds, names = [pa.string(), pa.int64(), *kinds], ["row_key", "pos", *names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def recipes(docs: DataFrame, digest: Digest = digest_of) -> DataFrame:
    """``doc_id, own_key, text_sha256, n_bytes, n_chunks, recipe`` of every row.

    ``recipe`` joins the 16-byte identifiers of the row's chunks in order; equal recipes stand for
    equal texts, since an identifier stands for one content.
    """
    texts = docs.select("doc_id", own_key(docs).alias("own_key"), normalised(F.col("text")).alias("text"))
    rows = texts.select("doc_id", "own_key", F.sha2("text", 256).alias("text_sha256"), "text").mapInArrow(
        partial(_recipes, digest=digest),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, own_key bigint, text_sha256 string, n_bytes bigint, "
        "n_chunks bigint, recipe binary",
    )
    contents = texts.select("text").mapInArrow(
        partial(_contents, digest=digest, places=False), "digest binary, chunk binary"
    )
    # Equal contents meet in every task first; each one then moves once.
    clashing = (
        contents.groupBy("digest", "chunk").agg(F.count("*").alias("places"))
        .groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")
    )
    clashing = staged(clashing, "clashing-digests")
    if clashing.isEmpty():
        return rows
    return _ranked(rows, texts, clashing, digest)


def _ranked(rows: DataFrame, texts: DataFrame, clashing: DataFrame, digest: Digest) -> DataFrame:
    """Recipes in which the chunks of a shared digest carry their rank among its contents."""
    key = F.sha2("text", 256)
    placed = (
        texts.select(key.alias("row_key"), "text").distinct()
        .mapInArrow(partial(_contents, digest=digest, places=True),
                    "row_key string, pos bigint, digest binary, chunk binary")
        .join(clashing, "digest")
    )
    # Dense ranks by content, among the few contents of one digest.
    contents = placed.select("digest", "chunk").distinct()
    listed = contents.groupBy("digest").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    marks = (
        placed.join(listed, "digest")
        .select("row_key", F.struct("pos", F.array_position("all", F.col("chunk")).alias("rank")).alias("mark"))
        .groupBy("row_key").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    )
    return (
        rows.join(marks, rows["text_sha256"] == marks["row_key"], "left")
        .withColumn("recipe", F.concat("recipe", F.coalesce(F.to_json("marks"), F.lit("")).cast("binary")))
        .select(*rows.columns)
    )


def classes(docs: DataFrame, digest: Digest = digest_of) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``; the largest id stays.

    Groups are counted in every task before they meet. Those of more than one row are written and
    joined back to the rows by recipe, where Spark may split a large group over tasks.
    """
    rows = staged(recipes(docs, digest), "recipes")
    groups = staged(rows.groupBy("n_bytes", "recipe").agg(
        F.max("doc_id").alias("_keep"), F.count("*").alias("_size")
    ).where("_size > 1"), "equal-texts")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.join(groups, ["n_bytes", "recipe"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_chunks",
    )


def deduplicated(docs: DataFrame, digest: Digest = digest_of) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    The largest id stays, a null one only where all are null; of its rows one.
    """
    found = staged(recipes(docs, digest).select("doc_id", "own_key", "n_bytes", "recipe"), "recipes")
    return one_per_group(docs, found, ["n_bytes", "recipe"], F.max)
