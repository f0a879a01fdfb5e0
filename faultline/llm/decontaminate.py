"""Benchmark decontamination by template canonicalisation.

Numbers, units behind numbers and names become typed placeholders, so that a question asked with other
values keeps its template. Windows of template words are hash-joined with those of the benchmark
items; matches of an item are put together, and the values in its slots must change consistently:
one value of the item stands for one value of the document, in all but a few slots; different values
may become equal. Windows are made in four ways: with names as words, since case may be lost, as
placeholders, with names in a row as one placeholder, and with capitalised words that open a sentence as
names too.

Benchmark windows are given to the tasks as sorted arrays of a bounded size, so the corpus is not
shuffled; a benchmark with more windows is joined in several such parts, each over all documents.

Defined results: null and empty texts match nothing, on either side; items shorter than a window
are matched by all their words, of which four must be plain words; an item whose id is null is reported
with null; repeated rows are reported each; further columns are ignored; empty tables give an empty
result. Very long texts are read whole; memory follows the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.rows import keyed, without
from faultline.llm.words import mix

WINDOW = 8
#: Plain words a window must hold, and the part of an item's words that its windows must cover.
PLAIN_WORDS, LEAST_COVER = 4, 0.5
#: Part of the slots that must agree with the most common value of the document for theirs.
LEAST_AGREEING = 0.8
#: Windows of the benchmark that are given to the tasks at once: 52 bytes each.
PART_WINDOWS = 1_000_000
PLACE_BYTES = 4 * (WINDOW + 1)

UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mile", "miles", "g", "mg",
    "kg", "t", "tons", "lb", "lbs", "oz", "ml", "cl", "l", "liters", "litres", "gallons", "s", "sec", "seconds",
    "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "hz", "khz", "mhz", "ghz", "v", "w", "kw",
    "kwh", "j", "kj", "cal", "kcal", "n", "pa", "bar", "k", "c", "f", "degrees", "percent", "usd", "eur", "dollars",
    "euros", "cents", "pounds", "meters", "metres", "kilometers", "kilograms", "grams", "kph", "mph",
)
_PLAIN, _NUMBER, _UNIT, _NAME, _OPENING = 0, 1, 2, 3, 4
#: Ways to make windows: the kinds that are names, and whether names in a row are one.
_WAYS = (((), False), ((_NAME,), False), ((_NAME,), True), ((_NAME, _OPENING), True))
_MARKS = mix(np.array([0, 101, 102, 103], np.uint64))
_BETWEEN_NAMES = np.zeros(256, dtype=bool)
_BETWEEN_NAMES[list(b" -'")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?:;\n\r|\"'([")] = True


def _unit_hashes() -> np.ndarray:
    return np.sort(words.Words(*words.text_bytes(pa.array(UNITS))).hashes)


class Templates:
    """The words of a block of texts with their kinds; decimals count as one number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = words.Words(data, offsets)
        starts, ends, h = found.starts, found.ends, found.hashes
        digits = np.concatenate([[0], np.cumsum(_DIGIT[found.data])])
        number = digits[ends] - digits[starts] == ends - starts
        first = np.zeros(len(h) + 1, dtype=bool)
        first[found.offsets] = True
        first = first[:-1]
        joined = np.zeros(len(h), dtype=bool)
        if len(h):
            gap = found.data[np.maximum(starts - 1, 0)]
            joined[1:] = (number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1)
                          & ((gap[1:] == 46) | (gap[1:] == 44)))
        joined &= ~first
        behind_number = np.zeros(len(h), dtype=bool)
        behind_number[1:] = number[:-1]
        behind_number &= ~first
        units = _unit_hashes()
        at = np.minimum(np.searchsorted(units, h), len(units) - 1)
        unit = behind_number & (units[at] == h)
        lead = data[starts] if len(h) else np.zeros(0, np.uint8)
        after_lead = data[np.minimum(starts + 1, len(data) - 1)] if len(h) else lead
        upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (after_lead >= 0x80) & (after_lead <= 0x9E)
        before = data[np.maximum(starts - 2, 0)] if len(h) else lead
        name = upper & ~first & ~_STOPS[before] & ~_STOPS[data[np.maximum(starts - 1, 0)]] if len(h) else upper
        # A capitalised word that opens a sentence may be a name or not.
        kind = np.select([number, unit, name, upper], [_NUMBER, _UNIT, _NAME, _OPENING], _PLAIN)
        follows = np.zeros(len(h), dtype=bool)
        if len(h):
            follows[1:] = (starts[1:] - ends[:-1] == 1) & _BETWEEN_NAMES[gap[1:]]
        follows &= ~first
        # A decimal's value is that of all its parts.
        value = h.copy()
        for i in np.flatnonzero(joined).tolist():
            value[i] = mix(value[i - 1:i] * np.uint64(31) + value[i:i + 1])[0]
        last = np.ones(len(h), dtype=bool)
        last[:-1] = ~joined[1:]
        self.value, self.kind, self.follows = value[last], kind[last], follows[last]
        # Of the names in a row that a word is one of: their last word and their number.
        begins = ~self._goes_on(self.kind >= _NAME)
        row, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
        ends = np.append(starts[1:], len(begins))
        self.last_name = self.value[ends - 1][row] if len(row) else self.value
        self.n_names = (ends - starts)[row] if len(row) else row
        kept = np.concatenate([[0], np.cumsum(last)])
        self.offsets = kept[found.offsets]

    def _goes_on(self, is_name: np.ndarray) -> np.ndarray:
        out = np.zeros(len(is_name), dtype=bool)
        out[1:] = is_name[1:] & is_name[:-1] & self.follows[1:]
        return out

    def tokens(self, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and kind of every token, and the texts' offsets among them."""
        named, merged = _WAYS[way]
        is_name = np.isin(self.kind, named)
        kind = np.where(is_name, _NAME, np.where(self.kind >= _NAME, _PLAIN, self.kind))
        words_ = np.flatnonzero(~self._goes_on(is_name)) if merged else np.arange(len(kind))
        return words_, kind[words_], np.searchsorted(words_, self.offsets)

    def windows(self, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows, 0 for those of too few plain words, the texts' offsets among them, and the bounds
        of all tokens in words."""
        starts_of, kind, texts = self.tokens(way)
        token = np.where(kind == _PLAIN, self.value[starts_of], _MARKS[kind])
        h, offsets = words.shingle_hashes(token, texts, WINDOW)
        counts = np.diff(texts)
        starts = np.arange(len(h)) - np.repeat(offsets[:-1] - texts[:-1], np.diff(offsets))
        sizes = np.repeat(np.minimum(counts, WINDOW), np.diff(offsets))
        plain = np.concatenate([[0], np.cumsum(kind == _PLAIN)])
        good = plain[starts + sizes] - plain[starts] >= PLAIN_WORDS
        return np.where(good, h, np.uint64(0)), offsets, np.append(starts_of, len(self.kind))


@words.tidy
def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = Templates(data, offsets)
            for way in range(len(_WAYS)):
                h, bounds, tokens = found.windows(way)
                text = np.repeat(np.arange(last - first), np.diff(bounds))
                at = np.searchsorted(tokens, found.offsets)
                sizes = np.minimum(np.diff(at), WINDOW)[text]
                token = at[text] + np.arange(len(h)) - bounds[text]
                good = h != 0
                yield pa.record_batch({
                    "window": h[good].view(np.int64),
                    "item": batch["item"].slice(first, last - first).take(pa.array(text[good])),
                    # The words at which the window's tokens begin, and its end; -1 behind that.
                    "place": pa.array([(tokens[t:t + n + 1] - found.offsets[k]).astype(np.int32).tobytes().ljust(PLACE_BYTES, b"\xff") for t, n, k in zip(
                        token[good].tolist(), sizes[good].tolist(), text[good].tolist(), strict=True)], pa.binary()),
                })


@words.tidy
def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = Templates(data, offsets)
            spans = list(zip(found.offsets[:-1], found.offsets[1:], strict=True))
            yield pa.record_batch({
                "item": batch["item"].slice(first, last - first),
                "values": pa.array([found.value[a:b].tobytes() for a, b in spans], pa.binary()),
                "kinds": pa.array([found.kind[a:b].astype(np.int8).tobytes() for a, b in spans], pa.binary()),
                "last_names": pa.array([found.last_name[a:b].tobytes() for a, b in spans], pa.binary()),
                "n_names": pa.array([found.n_names[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
            })


def consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether equal values of the item stand for equal values of the document, in ``LEAST_AGREEING`` of the slots."""
    often: dict[int, Counter] = {}
    for x, y in zip(item.tolist(), doc.tolist(), strict=True):
        often.setdefault(x, Counter())[y] += 1
    return sum(max(c.values()) for c in often.values()) >= LEAST_AGREEING * len(item)


def _paired(item: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Words that stand for each other in two windows; of names in a row of other lengths, the last ones."""
    for a, a_end, b, b_end in zip(item[:-1].tolist(), item[1:].tolist(), doc[:-1].tolist(), doc[1:].tolist(), strict=True):
        if a_end - a == b_end - b:
            yield from zip(range(a, a_end), range(b, b_end), strict=True)
        else:
            yield a_end - 1, b_end - 1


@words.tidy
def _matches(batches: Iterator[pa.RecordBatch], part, cover: float) -> Iterator[pa.RecordBatch]:
    windows, item_of, place_of, item_words = part.value
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = Templates(data, offsets)
            rows: dict[tuple[int, int], set[tuple[int, int]]] = {}
            covered: dict[tuple[int, int], set[int]] = {}
            for way in range(len(_WAYS)):
                h, bounds, tokens = found.windows(way)
                text_tokens = np.searchsorted(tokens, found.offsets)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(windows, h), len(windows) - 1)
                for i in np.flatnonzero((windows[at] == h) & (h != 0)).tolist():
                    text = int(np.searchsorted(bounds, i, "right")) - 1
                    j = int(at[i])
                    while j < len(windows) and windows[j] == h[i]:
                        key, place = (text, int(item_of[j])), place_of[j][place_of[j] >= 0]
                        token = int(text_tokens[text]) + i - int(bounds[text])
                        own = tokens[token:token + len(place)] - found.offsets[text]
                        rows.setdefault(key, set()).update(_paired(place, own))
                        covered.setdefault(key, set()).update(range(int(place[0]), int(place[-1])))
                        j += 1
            out = []
            for (text, item), pairs in rows.items():
                values, kinds, last_names, n_names = item_words[item]
                start, end = int(found.offsets[text]), int(found.offsets[text + 1])
                own_value, own_kind = found.value[start:end], found.kind[start:end]
                own_last, own_names = found.last_name[start:end], found.n_names[start:end]
                part_cover = len(covered[text, item]) / len(values)
                if part_cover < cover:
                    continue
                a, b = np.array(sorted(pairs)).T
                # A word of the item that fits in several places stands in the best aligned one.
                _, line, often = np.unique(b - a, return_inverse=True, return_counts=True)
                order = np.lexsort((b, -often[line], a))
                a, b = a[order], b[order]
                _, once = np.unique(a, return_index=True)
                a, b = a[once], b[once]
                slots = (kinds[a] != _PLAIN) & (np.minimum(kinds[a], _NAME) == np.minimum(own_kind[b], _NAME))
                # Names in a row stand for others word by word, or with their last word if there are more or fewer.
                alike = n_names[a] == own_names[b]
                x, y = np.where(alike, values[a], last_names[a]), np.where(alike, own_value[b], own_last[b])
                # An opening word that stays is no slot.
                slots &= (kinds[a] != _OPENING) | (x != y)
                x, y = x[slots], y[slots]
                if consistent(x, y):
                    out.append((first + text, item, int(b.min()), int(b.max()), part_cover, int(slots.sum()), int((x != y).sum())))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([
                    batch["doc_id"].take(pa.array(columns[0], pa.int64())), batch["own_key"].take(pa.array(columns[0], pa.int64())),
                    *(pa.array(c, pa.float64() if n == 4 else pa.int64()) for n, c in enumerate(columns) if n),
                ], ["doc_id", "own_key", "item", "first_word", "last_word", "cover", "n_slots", "n_changed"])


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = LEAST_COVER, part_windows: int = PART_WINDOWS) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, cover, n_slots, n_changed`` per document and item in it.

    ``cover`` is the part of the item's words that stand in the document; ``n_changed`` of its
    ``n_slots`` covered slots hold other values. Items of equal text are one, named by the smallest id.
    """
    return _leaks(docs, benchmark, cover, part_windows).drop("own_key")


def _leaks(docs: DataFrame, benchmark: DataFrame, cover: float = LEAST_COVER, part_windows: int = PART_WINDOWS) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("item", F.xxhash64("text"))
    # Counted before anything is given to the tasks; a part holds all windows of its items.
    windows = items.select("item", "text").mapInArrow(_item_windows, "window bigint, item bigint, place binary").distinct()
    parts = max(1, -(-windows.count() // part_windows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for number in range(parts):
        some = windows.where(F.pmod(F.col("item"), F.lit(parts)) == number).orderBy("window", "item", "place").toArrow()
        if not some.num_rows:
            continue
        here = items.select("item", "text").where(F.pmod(F.col("item"), F.lit(parts)) == number)
        texts = here.mapInArrow(_item_words, "item bigint, values binary, kinds binary, last_names binary, n_names binary").toArrow().to_pylist()
        part = spark.sparkContext.broadcast((
            some["window"].to_numpy(), some["item"].to_numpy(), 
            np.frombuffer(words.text_bytes(some["place"])[0].tobytes(), np.int32).reshape(-1, WINDOW + 1),
            {t["item"]: (np.frombuffer(t["values"], np.uint64), np.frombuffer(t["kinds"], np.int8),
                         np.frombuffer(t["last_names"], np.uint64), np.frombuffer(t["n_names"], np.int32)) for t in texts},
        ))
        matches = keyed(docs).mapInArrow(
            partial(_matches, part=part, cover=cover),
            f"doc_id {kind}, own_key bigint, item bigint, first_word bigint, last_word bigint, cover double, n_slots bigint, n_changed bigint",
        )
        found = matches if found is None else found.union(matches)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, own_key bigint, item_id {benchmark.schema['item_id'].dataType.simpleString()}, "
                                                 "first_word bigint, last_word bigint, cover double, n_slots bigint, n_changed bigint")
    return found.join(items.select("item", "item_id"), "item").drop("item").select(
        "doc_id", "own_key", "item_id", "first_word", "last_word", "cover", "n_slots", "n_changed"
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with all their columns."""
    return without(docs, _leaks(docs, benchmark, **settings))
