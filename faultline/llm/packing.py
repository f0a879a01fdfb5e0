"""Packing token sequences by minimum bin slack.

A document's ids, closed by an end id, are cut into windows of ``capacity``; what remains of each is
shorter than a window. The remainders are packed by length: a bitset dynamic program finds the
multiset of remaining lengths whose sum is closest to the capacity, counts are taken back along its
steps, and the multiset is used as often as its lengths last. The plan needs the number of
remainders per length only, at most ``capacity`` counters however large the corpus is; rows find
their place in it by their rank within their length.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed each;
null ids are kept; further columns are ignored; an empty table gives an empty result. Very long
texts are cut at spaces into batches of words for the tokenizer, never cut short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.staging import staged

END_ID = 1


def _ranked_encoding(path: str) -> tuple | None:
    """The file's vocabulary for ``tiktoken`` and the bytes of each id; None if it is not of that kind."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    model = json.loads(Path(path).read_text())
    if model.get("normalizer") or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    # Byte-level files write every byte as a visible character: itself, or one from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per process, dropped when a task ends: idle workers would hold its tables, 100 MB each."""
    return Encoder(path)


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library, each distinct word once.

    Byte-level BPE never merges across the space in front of a word, so a text may be cut before
    any single space that a visible character follows; equal pieces have equal ids. New words are
    encoded from the file's own vocabulary by ``tiktoken``, six times as fast as ``tokenizers``;
    every process compares the first words with ``tokenizers`` itself and stays with it if they
    differ.
    """

    #: Words remembered per task; the memory is emptied when it is full.
    MEMORY = 300_000
    COMPARED = 500

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast, self.compared = _ranked_encoding(path), 0
        self.forget()
        plain = np.zeros(256, dtype=bool)
        plain[33:127] = True
        plain[0xC3] = True  # leads the Latin letters from U+00C0 to U+00FF
        self.plain = plain

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and how many each has, by ``tokenizers``."""
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        lists = [one.ids for one in found]
        return (np.fromiter((i for ids in lists for i in ids), np.uint32),
                np.fromiter(map(len, lists), np.int64, len(lists)))

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with a space, encoded as one text and told apart by length."""
        encoding, sizes = self.fast
        ids = np.array(encoding.encode_ordinary(b"".join(pieces).decode()), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        bounds = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
        return ids, np.diff(bounds, prepend=0)

    def _learn(self, pieces: list[bytes]) -> None:
        spaced = [p for p in pieces if p[:1] == b" "] if self.fast else []
        for group in (spaced, [p for p in pieces if p[:1] != b" "] if self.fast else pieces):
            if not group:
                continue
            ids, counts = self._joined(group) if group is spaced else self._each(group)
            if group is spaced and self.compared < self.COMPARED:
                self.compared += len(group)
                some = group[:self.COMPARED]
                want, sizes = self._each(some)
                if not (np.array_equal(sizes, counts[:len(some)]) and np.array_equal(want, ids[:len(want)])):
                    self.fast = None
                    ids, counts = self._each(group)
            at = len(self.known)
            while at + len(group) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.starts[at:at + len(group)] = self.used + np.cumsum(counts) - counts
            self.counts[at:at + len(group)] = counts
            self.used += len(ids)
            self.known.update(zip(group, range(at, at + len(group)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and each text's offsets among them."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            cut[:-2] = (data[:-1] == 32) & self.plain[data[1:]]
        cut[offsets] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        prefix = words.prefix_hash(data)
        _, first, which = np.unique(words.span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        lengths = ends - starts
        alike = data[words.ragged(starts[first][which], lengths)] if (lengths == lengths[first][which]).all() else None
        if alike is None or not np.array_equal(alike, data):  # two words share a hash: go by content
            numbers: dict[bytes, int] = {}
            which = np.fromiter(
                (numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
                np.int64, len(starts),
            )
            pieces = list(numbers)
        else:
            pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) + len(pieces) > self.MEMORY and len(self.known) > self.MEMORY // 2:
            self.forget()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            self._learn(new)
        at = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))[which]
        counts = self.counts[at]
        ids = self.flat[words.ragged(self.starts[at], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, offsets)]


@words.tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    known = encoder(path)
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            ids, bounds = known.encode(data, offsets)
            rows, starts, lengths, crcs, totals, lists = [], [], [], [], [], []
            for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(ids[low:high], np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start:start + capacity]
                    rows.append(first + i)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(own))
                    if with_ids:
                        lists.append(piece)
            out = {"doc_id": batch["doc_id"].take(pa.array(rows, pa.int64()))}
            for name, values in (("start", starts), ("length", lengths), ("ids_crc32", crcs), ("doc_tokens", totals)):
                out[name] = pa.array(values, pa.int64())
            if with_ids:
                out["ids"] = pa.array(lists, pa.list_(pa.int64()))
            yield pa.record_batch(out)
    encoder.cache_clear()


def pieces(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece, and ``ids`` on request.

    Pieces are the document's full windows and its remainder; the checksum is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(
        partial(_pieces, path=path, capacity=capacity, with_ids=with_ids),
        schema + (", ids array<bigint>" if with_ids else ""),
    )


def fill(stock: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths in ``stock`` that holds its largest and sums closest to ``capacity``.

    The bits of ``sums`` are the sums that can be reached; every step keeps the bits it began with,
    so that the counts can be taken back.
    """
    lengths = sorted((n for n, count in stock.items() if count), reverse=True)
    room = capacity - lengths[0]
    chosen = {lengths[0]: 1}
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, times = min(stock[length] - (length == lengths[0]), room // length), 1
        while left > 0 and not sums >> room & 1:
            take = min(times, left)
            steps.append((length, take, sums))
            sums |= sums << (length * take) & mask
            left -= take
            times *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Rows ``length, first_rank, first_sequence, offset, per_sequence`` that place every piece.

    Pieces of ``length`` from rank ``first_rank`` on go, ``per_sequence`` at a time, to consecutive
    sequences from ``first_sequence`` on, one behind the other from ``offset`` on.
    """
    stock, used, sequence, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    while any(stock.values()):
        chosen = fill(stock, capacity)
        times = min(stock[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], sequence, offset, k))
            offset += n * k
            used[n] += times * k
            stock[n] -= times * k
        sequence += times
    return sorted(rows)


@words.tidy
def _placed(batches: Iterator[pa.RecordBatch], rows: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    table = np.array(rows or [(0, 0, 0, 0, 1)], np.int64)
    step = np.int64(1) << np.int64(48)
    keys = table[:, 0] * step + table[:, 1]
    for batch in batches:
        length, rank = (np.asarray(batch[name]) for name in ("length", "_rank"))
        at = np.searchsorted(keys, length * step + rank, "right") - 1
        _, since, sequence, offset, per = table[at].T
        rest = batch.select([n for n in batch.schema.names if n != "_rank"])
        yield pa.record_batch(
            [*rest.columns, pa.array(sequence + (rank - since) // per), pa.array(offset + (rank - since) % per * length)],
            [*rest.schema.names, "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their ``sequence_id`` and ``offset``.

    Texts are read and encoded once; the pieces are written to the shared folder, where file and row
    number name a row for good. Ranks are made within a length and file, so no length, however
    common, is ranked by one task.
    """
    # `_metadata` belongs to the file scan, so the pieces are read by their own name.
    own = staged(pieces(docs, path, capacity, with_ids), "pieces").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = staged(own.groupBy("length", "_file").agg(F.count("*").alias("_n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = sizes.select("length", "_file", F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    ranked = own.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_file").orderBy("_row")) - 1
    ).join(before, ["length", "_file"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [n for n in own.columns if n[0] != "_"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in names)
    return ranked.select(*names, "_rank").mapInArrow(
        partial(_placed, rows=plan(counts, capacity)), f"{kinds}, sequence_id bigint, offset bigint"
    )
