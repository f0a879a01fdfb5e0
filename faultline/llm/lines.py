"""Fuzzy line deduplication by MinHash of character shingles.

Equal lines (A-Z lower-cased, outer blanks stripped) are one before anything is compared. Distinct
lines get minhashes of their five-byte shingles; lines that agree in a band of four minima are
candidates, and ten bands find 99.5 % of the pairs at the threshold of 0.8, more above. Sketches of
lines that share a band, 32 bytes each, are compared where the band is, and sets of shingles of those
that look alike; a bitmap picks either where they are, so that texts stay in place. Exact Jaccard similarity of the sets decides, and
distributed union-find keeps one line per component: the first one of the smallest document.

Shingles of five bytes link lines from about 45 bytes on that differ in one letter, and still keep
unrelated lines of one language apart, which share most shorter ones.

Defined results: null and empty texts, and blank lines, have no lines here; a line shorter than a
shingle is one shingle; rows that agree in id and text are one row, and a decision holds for all of
them; other rows of a repeated id are told apart by their text; rows without ``doc_id`` are compared
and come last among equals; further columns are ignored; an empty table gives an empty result. Lines
of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.components import components
from faultline.llm.rows import keyed
from faultline.llm.similar import (
    BLOCK_SETS, HALVES, agreeing, bitmap, bucket_values, exact_links, half_values, in_bitmap, likely_pairs, minima,
)
from faultline.llm.staging import dropped, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4
#: Names of lines that a task remembers, so as to band a line once; beyond that it begins anew.
REMEMBERED = 1 << 17

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 11, 12, 13, 32]] = True


class Lines:
    """The lines of a block of texts, stripped: byte spans, text numbers and names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
        breaks = np.flatnonzero(self.data == 10)
        # A line begins at its text or behind a line end; its number counts the line ends before it in its text.
        starts = np.concatenate([offsets[:-1], breaks + 1])
        text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        number = np.arange(len(starts)) - np.searchsorted(text, text)
        ends = np.empty_like(starts)
        last = np.append(text[1:] != text[:-1], True)[:len(text)]
        ends[:-1], ends[last] = starts[1:] - 1, offsets[text[last] + 1]
        starts, ends = _stripped(self.data, starts, ends)
        some = ends > starts
        self.starts, self.ends, self.text, self.number = starts[some], ends[some], text[some], number[some]
        self.prefix = words.prefix_hash(self.data)
        self.names = words.span_hash(self.prefix, self.starts, self.ends).view(np.int64)

    def shingles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the chosen lines, in order, and the lines' offsets among them."""
        return _shingles(self.prefix, self.starts[chosen], self.ends[chosen])


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks at their ends; those of blanks alone are empty."""
    starts, ends = starts.copy(), ends.copy()
    for at, step, byte in ((starts, 1, 0), (ends, -1, -1)):
        left = np.flatnonzero(starts < ends)
        for _ in range(64):
            left = left[_BLANK[data[at[left] + byte]]]
            if not len(left):
                break
            at[left] += step
            left = left[starts[left] < ends[left]]
        if len(left):  # many blanks: look the next byte with ink up
            ink = np.flatnonzero(~_BLANK[data])
            if step > 0:
                at[left] = np.minimum(np.append(ink, len(data))[np.searchsorted(ink, starts[left])], ends[left])
            else:
                at[left] = np.maximum(np.append(ink, -1)[np.searchsorted(ink, ends[left]) - 1] + 1, starts[left])
    return starts, ends


def _shingles(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(ends - starts - SHINGLE + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if len(prefix) <= SHINGLE:
        return words.span_hash(prefix, starts, ends), offsets
    # The hash of every place but the last few, then those within the lines; short lines are one by themselves.
    every = words.mix((prefix[SHINGLE:] - prefix[:-SHINGLE]) * words._power("down", len(prefix))[:len(prefix) - SHINGLE])
    out = every[np.minimum(words.ragged(starts, counts), len(every) - 1)]
    short = np.flatnonzero(ends - starts < SHINGLE)
    out[offsets[short]] = words.span_hash(prefix, starts[short], ends[short])
    return out, offsets


def _sets(lines: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each line, which take eight times the room of the line."""
    data, offsets = words.text_bytes(lines)
    return words.distinct_per_text(*_shingles(words.prefix_hash(data), offsets[:-1], offsets[1:]))


@words.tidy
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = np.zeros(0, np.int64)
    for batch in batches:
        for first, _, data, offsets in words.blocks(batch["text"]):
            found = Lines(data, offsets)
            rows = pa.array(first + found.text)
            # Equal lines of a task: one of them is banded.
            names, chosen = np.unique(found.names, return_index=True)
            new = ~_among(before, names)
            before = np.sort(np.concatenate([before, names[new]]), kind="stable") if len(before) < REMEMBERED else names
            chosen = np.sort(chosen[new])
            h, own = found.shingles(chosen)
            least = minima(h.astype(np.uint32), own)
            at = np.zeros(len(found.names), np.int64)
            at[chosen] = np.arange(len(chosen))
            banded = np.zeros(len(found.names), bool)
            banded[chosen] = True
            at = pa.array(at, mask=~banded)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].take(rows), "own_key": batch["own_key"].take(rows),
                "line": pa.array(found.number, pa.int64()), "id": pa.array(found.names),
                "buckets": bucket_values(least, BANDS, ROWS).take(at), "sketch": half_values(least).take(at),
            })


def _among(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


@words.tidy
def _sharing(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch["buckets"].flatten()
        wanted = in_bitmap(bits.value, buckets.to_numpy())
        # The buckets that pass, line by line; lines without any go no further.
        ends = np.concatenate([[0], np.cumsum(wanted)])[batch["buckets"].offsets.to_numpy() - batch["buckets"].offsets[0].as_py()]
        some = pa.array(np.diff(ends) > 0)
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), buckets.filter(pa.array(wanted)))
        yield pa.record_batch({"id": batch["id"], "buckets": kept, "sketch": batch["sketch"]}).filter(some)


@words.tidy
def _shown(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in words.blocks(batch["text"]):
            found = Lines(data, offsets)
            names, chosen = np.unique(found.names, return_index=True)
            wanted = in_bitmap(bits.value, names)
            names, chosen = names[wanted], chosen[wanted]
            shown = found.data.tobytes()
            yield pa.record_batch({
                "id": names, "hashes": pa.array([shown[a:b] for a, b in zip(
                    found.starts[chosen].tolist(), found.ends[chosen].tolist(), strict=True)], pa.binary()),
            })


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, line, line_id, class_id, class_lines, kept`` of every line that is not blank.

    ``line`` counts from 0 in the text; ``line_id`` names equal lines and ``class_id`` those that
    links join; ``kept`` is the first line of its class.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = keyed(docs)
    wide = staged(texts.mapInArrow(
        _listed, f"doc_id {kind}, own_key bigint, line bigint, id bigint, buckets array<bigint>, sketch binary"), "banded-lines")
    rows = staged(wide.select("doc_id", "own_key", "line", "id"), "lines")
    banded = wide.where("buckets IS NOT NULL").select("id", "buckets", "sketch")
    # Buckets that come twice, of whatever lines: a bitmap of them leaves few lines to look at in earnest.
    # A task has hardly any twice, so they are counted where they meet.
    twice = staged(banded.select(F.explode("buckets").alias("bucket")).repartition("bucket").groupBy("bucket").agg(
        F.count("*").alias("size")).where("size > 1"), "repeated-bands")
    # Sketches go to their buckets at once; what a bucket has of one line, or the bitmap lets pass, ends there.
    sharing = banded.mapInArrow(
        partial(_sharing, bits=bitmap(twice, "bucket")), "id bigint, buckets array<bigint>, sketch binary"
    ).select("id", "sketch", F.explode("buckets").alias("bucket"))
    large = staged(twice.where(F.col("size") > BLOCK_SETS), "large-bands")
    nodes = sharing.join(large, "bucket", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    likely = staged(likely_pairs(nodes, agreeing(similarity + (1 - similarity) / 16), HALVES).distinct(), "likely-lines")
    dropped(wide, twice, large)
    roots = staged(components(likely), "line-roots")
    dropped(likely)
    # Lines go to where they are compared as they are; their sets are made there. What else passes is of no root.
    shown = texts.select("text").mapInArrow(partial(_shown, bits=bitmap(roots, "id")), "id bigint, hashes binary")
    members = staged(shown.dropDuplicates(["id"]).join(roots, "id"), "compared-lines")
    _, named = exact_links(members, similarity, _sets, 8)
    named = staged(named, "line-classes")
    dropped(members, roots)
    # The place of a line, which sorts as lines are kept: ids first, nulls last.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own_key", "line")
    found = staged(rows.join(named, "id", "left").select(
        "doc_id", "own_key", "line", F.col("id").alias("line_id"), F.coalesce("root", "id").alias("class_id")
    ), "classed-lines")
    dropped(rows, named)
    firsts = staged(found.groupBy("class_id").agg(
        F.min(place).alias("_first"), F.count("*").alias("class_lines")
    ).where("class_lines > 1"), "first-lines")
    return found.join(firsts, "class_id", "left").select(
        "doc_id", "line", "line_id", "class_id", F.coalesce("class_lines", F.lit(1)).cast("bigint").alias("class_lines"),
        F.coalesce(place == F.col("_first"), F.lit(True)).alias("kept"),
    )
