"""Substring deduplication by MinHash of paragraphs.

Paragraphs are overlapping windows of ``WINDOW`` words around anchors: a word is an anchor if the hash
of the three words from it on is the largest among ``RADIUS`` words on either side. Equal stretches
have equal anchors, wherever they stand and however their lines are wrapped, so that of the passages
of 51 words 98 % hold a whole window, of 60 words 99.8 %, and a near copy holds one between its edits.

Distinct windows are banded by pairs of minima of their five-word shingles: four bands find 98 % of
the pairs at the threshold of 0.8, and a passage has several windows. Colliding windows are compared exactly, and components of links of
0.8 or more, and of exact copies, are the clusters. Every occurrence is extended by the words around it
that it shares with the first one of its cluster, up to ``REACH`` on either side, so that the spans of a
passage's windows meet its ends, give or take the two words in which linked windows may differ. The first occurrence stays, the spans of the others go.

Defined results: null and empty texts, and texts of fewer words than a window, have no paragraphs;
what repeats in one document alone is left alone; rows that agree in id and text are one document,
and each has its spans; rows without ``doc_id`` are compared and come last among equals; further
columns are ignored; an empty table gives an empty result. Spans of one document may overlap. Very long
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.rows import keyed
from faultline.llm.similar import agreeing, alike, band_values, exact_links, minima, partnered, sketch_values
from faultline.llm.staging import dropped, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 4, 2
#: Words of a window, those before its anchor, and those around an anchor that decide it.
WINDOW, BEFORE, RADIUS = 24, 10, 8
#: Words around a window that are compared with those of the first occurrence.
REACH = 40


def _largest(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of every ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.maximum(values[:-step], values[step:])
        done += step
    return values


class Windows:
    """The windows of a block of texts: first words, text numbers and names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = words.Words(data, offsets)
        self.hashes = h = found.hashes
        self.text_offsets = found.offsets
        counts = np.diff(found.offsets)
        text = np.repeat(np.arange(len(counts)), counts)
        # Zeros between the texts keep them apart; the last two words of a text begin no three.
        at = np.arange(len(h)) + RADIUS * (text + 1)
        padded = np.zeros(len(h) + RADIUS * (len(counts) + 1), np.uint64)
        if len(h) > 2:
            key = words.mix((h[:-2] * words._STEP + h[1:-1]) * words._STEP + h[2:]) | np.uint64(1)
            inside = text[:-2] == text[2:]
            padded[at[:-2][inside]] = key[inside]
        around = _largest(padded, RADIUS)
        # Of equal ones in reach the first is the anchor.
        anchors = np.flatnonzero((padded[at] > around[at - RADIUS]) & (padded[at] >= around[at + 1]))
        anchors = anchors[counts[text[anchors]] >= WINDOW]
        low, high = found.offsets[text[anchors]], found.offsets[text[anchors] + 1]
        self.starts = np.unique(np.clip(anchors - BEFORE, low, high - WINDOW))
        self.text = text[self.starts]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * words._power("up", len(h))[:len(h)])])
        down = words._power("down", len(h) + 1)[self.starts]
        self.names = words.mix((prefix[self.starts + WINDOW] - prefix[self.starts]) * down).view(np.int64)

    def shingles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the chosen windows and the windows' offsets among them."""
        places = words.ragged(self.starts[chosen], np.full(len(chosen), WINDOW))
        return words.shingle_hashes(self.hashes[places], np.arange(len(chosen) + 1) * WINDOW, SHINGLE)

    def around(self, text: int, first: int) -> tuple[bytes, bytes]:
        """Words before a window of a text, the nearest first, and behind it; 32 bits of each hash."""
        low, high = self.text_offsets[text:text + 2]
        start = int(low) + first
        before, behind = self.hashes[max(low, start - REACH):start], self.hashes[start + WINDOW:min(high, start + WINDOW + REACH)]
        return tuple((x >> np.uint64(32)).astype(np.uint32).tobytes() for x in (before[::-1], behind))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in words.blocks(batch["text"]):
            found = Windows(data, offsets)
            rows = pa.array(first + found.text)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].take(rows), "own_key": batch["own_key"].take(rows),
                "word": pa.array(found.starts - found.text_offsets[found.text], pa.int64()), "id": pa.array(found.names),
            })


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in words.blocks(batch["text"]):
            found = Windows(data, offsets)
            names, chosen = np.unique(found.names, return_index=True)
            least = minima(*found.shingles(chosen), BANDS * ROWS)
            yield pa.record_batch({"id": names, "bands": band_values(least, BANDS, ROWS)})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = Windows(data, offsets)
            names, chosen = np.unique(found.names, return_index=True)
            wanted = np.isin(names, batch["ids"].slice(first, last - first).flatten().to_numpy())
            names, chosen = names[wanted], chosen[wanted]
            h, bounds = words.distinct_per_text(*found.shingles(chosen))
            yield pa.record_batch({
                "id": names, "sketch": sketch_values(minima(h, bounds)),
                "hashes": pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            })


def _surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = Windows(data, offsets)
            lists = batch["windows"].slice(first, last - first)
            text = np.repeat(np.arange(last - first), lists.value_lengths().to_numpy())
            windows = lists.flatten()
            word = windows.field("word")
            sides = [found.around(t, w) for t, w in zip(text.tolist(), word.to_pylist(), strict=True)]
            rows = pa.array(first + text, pa.int64())
            yield pa.record_batch({
                "doc_id": batch["doc_id"].take(rows), "own_key": batch["own_key"].take(rows),
                "word": word, "class_id": windows.field("class_id"),
                "before": pa.array([b for b, _ in sides], pa.binary()), "behind": pa.array([b for _, b in sides], pa.binary()),
            })


def _equal_words(own: pa.Array, other: pa.Array) -> np.ndarray:
    """How many words of each row agree with the other's, from the first on."""
    def square(column: pa.Array, none: int) -> np.ndarray:
        data, offsets = words.text_bytes(column)
        counts = np.diff(offsets) // 4
        out = np.full((len(counts), REACH + 1), none, np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        out[row, np.arange(len(row)) - np.repeat(offsets[:-1] // 4, counts)] = np.frombuffer(data.tobytes(), np.uint32)
        return out

    return (square(own, -1) != square(other, -2)).argmax(1)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n not in ("before", "behind", "first_before", "first_behind")]
        yield pa.record_batch({
            **{n: batch[n] for n in kept},
            "more_before": _equal_words(batch["before"], batch["first_before"]),
            "more_behind": _equal_words(batch["behind"], batch["first_behind"]),
        })


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, first_word, last_word, class_id, class_size, removed`` of every repeated span.

    Words count from 0 in the text. ``class_id`` names the cluster; all its spans but the first, of
    the smallest ``doc_id``, are removed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = keyed(docs)
    rows = staged(texts.mapInArrow(_listed, f"doc_id {kind}, own_key bigint, word bigint, id bigint"), "windows")
    bands = staged(texts.select("text").mapInArrow(_banded, "id bigint, bands array<bigint>").dropDuplicates(["id"]), "window-bands")
    nodes = partnered(bands)
    dropped(bands)
    places = staged(rows.groupBy("id").agg(F.min("own_key").alias("own_key"), F.count("*").alias("n")), "window-names")
    # Shingles of windows that share a band, each from one text that holds it; a list is of one text's windows.
    wanted = nodes.select("id").distinct().join(places.select("id", "own_key"), "id")
    wanted = staged(wanted.groupBy("own_key").agg(F.collect_list("id").alias("ids")), "partnered-windows")
    # Equal rows meet before the join, by the same key; after it every window is made once.
    once = texts.select("own_key", "text").dropDuplicates(["own_key"])
    hashes = staged(once.join(wanted, "own_key").select("text", "ids").mapInArrow(
        _hashed, "id bigint, sketch binary, hashes binary"), "window-hashes")
    dropped(wanted)
    roots = staged(alike(nodes, hashes.select("id", "sketch"), agreeing(similarity)), "window-roots")
    dropped(nodes)
    _, named = exact_links(hashes.select("id", "hashes").join(roots, "id"), similarity)
    # Windows of links, and exact copies without any.
    named = staged(places.join(named, "id", "left").where("root IS NOT NULL OR n > 1").select(
        "id", F.coalesce("root", "id").alias("class_id")
    ), "window-classes")
    dropped(hashes, roots, places)
    # One row per document and window, that of the first document first; a class of one document is none.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own_key", "word")
    found = staged(rows.join(named, "id").select("doc_id", "own_key", "word", "class_id"), "classed-windows")
    dropped(rows, named)
    firsts = staged(found.groupBy("class_id").agg(
        F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("class_size")
    ).where("NOT (_first.doc_id <=> _last.doc_id AND _first.own_key = _last.own_key)").select("class_id", "_first", "class_size"), "first-windows")
    listed = found.join(firsts.select("class_id"), "class_id").select("own_key", "word", "class_id").distinct()
    listed = listed.groupBy("own_key").agg(F.collect_list(F.struct("word", "class_id")).alias("windows"))
    spans = staged(texts.join(listed, "own_key").select("doc_id", "own_key", "text", "windows").mapInArrow(
        _surrounded, f"doc_id {kind}, own_key bigint, word bigint, class_id bigint, before binary, behind binary"
    ), "surrounded-windows")
    dropped(found)
    marked = spans.join(firsts, "class_id").withColumn("removed", place != F.col("_first")).drop("_first")
    first = marked.where("NOT removed").dropDuplicates(["class_id"]).select(
        "class_id", F.col("before").alias("first_before"), F.col("behind").alias("first_behind")
    )
    extended = staged(marked.join(first, "class_id").drop("own_key").mapInArrow(
        _extended, f"class_id bigint, doc_id {kind}, word bigint, class_size bigint, removed boolean, "
                   "more_before bigint, more_behind bigint",
    ), "extended-windows")
    dropped(spans, firsts)
    # The first occurrence reaches as far as the farthest of the others.
    farthest = extended.where("removed").groupBy("class_id").agg(
        F.max("more_before").alias("_before"), F.max("more_behind").alias("_behind")
    )
    own = [F.when(F.col("removed"), F.col(f"more_{side}")).otherwise(F.coalesce(f"_{side}", F.lit(0))) for side in ("before", "behind")]
    return extended.join(farthest, "class_id", "left").select(
        "doc_id", (F.col("word") - own[0]).alias("first_word"), (F.col("word") + WINDOW - 1 + own[1]).alias("last_word"),
        "class_id", "class_size", "removed",
    )
