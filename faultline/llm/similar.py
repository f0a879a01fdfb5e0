"""Exact links between sets of hashes, from buckets of sets that may be alike.

The operators differ in how they make buckets; what follows is common. Inside a bucket sketches are
compared and only a spanning forest of the likely pairs leaves it, so a bucket of any size gives few
rows. The forests' components hold every link the buckets can show; in each component the sets
themselves are compared once, which gives exact links and their number without listing pairs.
Buckets and components beyond a bound are dealt with in pairs of blocks, each a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.components import components
from faultline.llm.staging import dropped, staged

SKETCH = 64
#: Sets of a bucket or component compared in one group; more are split into pairs of blocks.
BLOCK_SETS = 1024
BLOCK_BYTES = 16 << 20
#: Groups up to this size are compared side by side, larger ones one by one.
SMALL_GROUP = 16
#: The kind of sketches that hold four bits of each minimum, two of them in a byte.
HALVES = "halves"
#: Bits of the filter that picks what to compare; 2**27 take 16 MB.
FILTER_BITS = 27

#: From a column, the hashes of all its sets and the sets' offsets among them.
SetsOf = Callable[[pa.ChunkedArray], tuple[np.ndarray, np.ndarray]]

_FACTORS = words.mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: The lowest bit of each half byte.
_HALF_ONES = np.uint64(0x1111111111111111)


def minima(h: np.ndarray, offsets: np.ndarray, count: int = SKETCH) -> np.ndarray:
    """For every text ``count`` minima, up to 256, of its hashes under different orders; all ones for none.

    Hashes of 32 bits give minima of 32 bits, in half the time.
    """
    out = np.full((len(offsets) - 1, count), np.iinfo(h.dtype).max, h.dtype)
    factors = _FACTORS if h.dtype == np.uint64 else (_FACTORS >> np.uint64(32)).astype(h.dtype) | h.dtype.type(1)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    # A few texts at a time, so that their hashes stay in the processor's cache.
    step = (1 << 18) // h.itemsize
    low = 0
    while low < len(filled):
        high = int(np.searchsorted(offsets[filled], offsets[filled[low]] + step, "right"))
        high = min(max(high, low + 1), len(filled))
        some = filled[low:high]
        part = h[offsets[some[0]]:offsets[some[-1] + 1]]
        at = offsets[some] - offsets[some[0]]
        for i in range(count):
            out[some, i] = np.minimum.reduceat(part * factors[i], at)
        low = high
    return out


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set of distinct hashes, 0 for the empty set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(h), dtype=np.uint64)])
    a, b = total[offsets[1:]] - total[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
    names = words.mix(words.mix(a) * np.uint64(3) + b + np.diff(offsets).astype(np.uint64))
    return np.where(np.diff(offsets) > 0, names, np.uint64(0)).view(np.int64)


def _streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by the first ``keys`` columns, with the groups' bounds."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        held = pa.Table.from_batches(rest).combine_chunks()
        bounds = _bounds(held, keys)
        if len(bounds) > 2:
            yield held.slice(0, int(bounds[-2])), bounds[:-1]
            rest = held.slice(int(bounds[-2])).to_batches()
    if rest:
        held = pa.Table.from_batches(rest).combine_chunks()
        if held.num_rows:
            yield held, _bounds(held, keys)


def _bounds(held: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(held.num_rows, dtype=bool)
    if held.num_rows:
        new[1:] = False
        for i in range(keys):
            column = held.column(i).to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), held.num_rows)


def _forest(likely, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``likely(i)`` gives the partners of row ``i``."""
    root, edges = np.arange(n), []
    for i in range(n):
        partners = likely(i)
        if not len(partners):
            continue
        labels, first = np.unique(root[partners], return_index=True)
        for label, at in zip(labels.tolist(), first.tolist(), strict=True):
            if label != root[i]:
                edges.append((i, int(partners[at])))
                root[root == label] = root[i]
    return edges


def _agreement(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """In how many places the sketches of each row agree."""
    if kind != HALVES:
        return (a == b).sum(1)
    other = a ^ b
    other |= other >> np.uint64(1)
    other |= other >> np.uint64(2)
    other &= _HALF_ONES
    return SKETCH - np.bitwise_count(other).sum(1, dtype=np.int64)


def _connected(sketches: np.ndarray, block: np.ndarray, crossing: bool, least: int, kind: str) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a group; a row that is connected is compared with no other connected one."""
    edges, left = [], np.arange(len(sketches))
    rest = sketches
    while len(left):
        queue, left, rest = [int(left[0])], left[1:], rest[1:]
        while queue and len(left):
            k = queue.pop()
            near = _agreement(rest, sketches[k:k + 1], kind) >= least
            if crossing:
                near &= block[left] != block[k]
            if near.any():
                found = left[near].tolist()
                edges += [(k, x) for x in found]
                queue += found
                left, rest = left[~near], rest[~near]
    return edges


def _small_forests(sketches: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the edges of a spanning forest in each of many small groups, all groups at once."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    root = np.tile(np.arange(most), (len(starts), 1))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for y in range(1, most):
        having = int(np.searchsorted(-sizes, -y, "left"))
        for x in range(y):
            group = np.flatnonzero(root[:having, x] != root[:having, y])
            first, second = starts[group] + x, starts[group] + y
            near = _agreement(sketches[first], sketches[second], kind) >= least
            group = group[near]
            a.append(first[near])
            b.append(second[near])
            own = root[group]
            root[group] = np.where(own == own[:, y:y + 1], own[:, x:x + 1], own)
    return np.concatenate(a), np.concatenate(b)


@words.tidy
def _likely_pairs(batches: Iterator[pa.RecordBatch], least: int, kind: str) -> Iterator[pa.RecordBatch]:
    # columns: bucket, i, j, block, id, sketch
    for held, bounds in _streamed(batches, 3):
        ids = held.column("id").to_numpy()
        block, i, j = (held.column(n).to_numpy() for n in ("block", "i", "j"))
        data, offsets = words.text_bytes(held.column("sketch"))
        sketches = np.frombuffer(data.tobytes(), "u8" if kind == HALVES else kind).reshape(len(offsets) - 1, -1)
        # A row may come more than once in its group; copies lie side by side.
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (block[1:] != block[:-1])
        new[bounds[:-1]] = True
        if not new.all():
            bounds = np.concatenate([[0], np.cumsum(new)])[bounds]
            ids, block, i, j, sketches = ids[new], block[new], i[new], j[new], sketches[new]
        starts, sizes = bounds[:-1], np.diff(bounds)
        crossing = i[starts] != j[starts]
        small = (sizes > 1) & (sizes <= SMALL_GROUP) & ~crossing
        x, y = _small_forests(sketches, starts[small], sizes[small], least, kind)
        a, b = [ids[x]], [ids[y]]
        for g in np.flatnonzero((sizes > 1) & ~small).tolist():
            start, size = int(starts[g]), int(sizes[g])
            edges = _connected(sketches[start:start + size], block[start:start + size], crossing[g], least, kind)
            if edges:
                found = np.array(edges) + start
                a.append(ids[found[:, 0]])
                b.append(ids[found[:, 1]])
        yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})


def in_block_pairs(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows of every ``key`` once per pair of blocks they take part in: ``i``, ``j`` and own ``block``.

    ``blocks`` is the number of blocks of the key; one block gives each row once.
    """
    rows = rows.withColumn("_n", F.greatest(blocks.cast("bigint"), F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("_n"))
    )
    return rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).withColumns({
        "i": F.least("block", "_other"), "j": F.greatest("block", "_other"),
    }).drop("_n", "_other")


def agreeing(least_similarity: float) -> int:
    """Places in which sketches agree at a similarity, less three standard deviations."""
    spread = (least_similarity * (1 - least_similarity) / SKETCH) ** 0.5
    return int((least_similarity - 3 * spread) * SKETCH)


def likely_pairs(rows: DataFrame, least: int, kind: str = "u4") -> DataFrame:
    """Spanning forests ``a, b`` of the pairs that look alike in buckets.

    ``rows``: ``bucket`` (bigint), ``size`` (rows of the bucket), ``id`` (bigint), ``sketch`` (numbers
    of ``kind``). A pair looks alike if its sketches agree in ``least`` places.
    """
    rows = in_block_pairs(rows, "bucket", F.ceil(F.col("size") / BLOCK_SETS))
    return (
        rows.select("bucket", "i", "j", "block", "id", "sketch")
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "id")
        .mapInArrow(partial(_likely_pairs, least=least, kind=kind), "a bigint, b bigint")
    )


def bitmap(keys: DataFrame, column: str):
    """A broadcast filter that lets all of the 64-bit ``keys`` pass and few others.

    It has ``FILTER_BITS`` bits, whatever the number of keys, so that what is filtered stays where it is.
    """
    place = F.shiftrightunsigned(column, 64 - FILTER_BITS) + 1
    parts = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits")
    ).toArrow()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, own in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        bits[(part - 1) * len(own):part * len(own)] = np.frombuffer(own, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def partnered(sets: DataFrame) -> DataFrame:
    """``bucket, id, size`` of the bands that several sets (``id, bands``) share, written.

    Bands are counted in every task before they meet; those of one set go no further.
    """
    return bucketed(sets.select("id", F.posexplode("bands").alias("band", "value")).select(
        "id", F.xxhash64("band", "value").alias("bucket")
    ))


def bucketed(level: DataFrame) -> DataFrame:
    """``bucket, id, size`` of the buckets that several sets share, of ``id, bucket`` once each, written."""
    sizes = staged(level.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "band-sizes")
    nodes = staged(level.join(sizes, "bucket"), "band-nodes")
    dropped(sizes)
    return nodes


def alike(nodes: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Components of what ``partnered`` gives, by ``sketches`` (``id, sketch``)."""
    likely = staged(likely_pairs(nodes.join(sketches, "id"), least, "u2").distinct(), "likely")
    found = components(likely)
    dropped(likely)
    return found


def _bands(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(least), bands), np.uint64)
    for k in range(rows):
        out = words.mix(out * np.uint64(3) + least[:, k:bands * rows:rows])
    return out


def band_values(least: np.ndarray, bands: int, rows: int) -> pa.Array:
    """The first ``bands`` times ``rows`` minima of every text, hashed band by band."""
    return _lists(_bands(least, bands, rows))


def bucket_values(least: np.ndarray, bands: int, rows: int) -> pa.Array:
    """The same, hashed with the number of the band."""
    return _lists(words.mix(_bands(least, bands, rows) + words.mix(np.arange(1, bands + 1, dtype=np.uint64))))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.view(np.int64).ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def sketch_values(least: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in (least >> np.uint64(32)).astype(np.uint16)], pa.binary())


def half_values(least: np.ndarray) -> pa.Array:
    """Sketches of four bits of each of the 32-bit minima: others agree in one place of 16 by chance."""
    four = ((least ^ least >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    both = four[:, ::2] | four[:, 1::2] << np.uint8(4)
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(both.shape[1]), len(both), [None, pa.py_buffer(both.tobytes())]
    ).cast(pa.binary())


def joined_hashes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as their hashes, and their offsets."""
    data, offsets = words.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8


@words.tidy
def _exact(batches: Iterator[pa.RecordBatch], similarity: float, sets_of: SetsOf) -> Iterator[pa.RecordBatch]:
    # columns: root, i, j, block, id, hashes
    for held, bounds in _streamed(batches, 3):
        ids = held.column("id").to_numpy()
        block, i, j = (held.column(n).to_numpy() for n in ("block", "i", "j"))
        h, offsets = sets_of(held.column("hashes"))
        out_id, out_links, out_a, out_b = [], [], [], []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            size, crossing = end - start, i[start] != j[start]
            if size < 2:
                continue
            own_h, own_offsets = h[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
            if size == 2 and not crossing:
                both = np.sort(own_h)
                shared = np.float32(np.count_nonzero(both[1:] == both[:-1]))
                if shared >= np.float32(similarity) * (np.float32(len(both)) - shared) - np.float32(1e-4):
                    out_id.append(ids[start:end])
                    out_links.append(np.ones(2, np.int64))
                    out_a.append(ids[start])
                    out_b.append(ids[start + 1])
                continue
            common = _intersections(own_h, np.diff(own_offsets))
            counts = np.diff(own_offsets).astype(np.float32)
            linked = common >= np.float32(similarity) * (counts[:, None] + counts[None, :] - common) - 1e-4
            np.fill_diagonal(linked, False)
            if crossing:
                own = block[start:end]
                linked &= own[:, None] != own[None, :]
            out_id.append(ids[start:end])
            out_links.append(linked.sum(1))
            for x, y in _forest(lambda k, m=linked: np.flatnonzero(m[k, k + 1:]) + k + 1, size):
                out_a.append(ids[start + x])
                out_b.append(ids[start + y])
        n = sum(map(len, out_id))
        yield pa.record_batch({
            "id": np.concatenate([*out_id, np.array(out_a, np.int64)]).astype(np.int64),
            "links": np.concatenate([*out_links, np.zeros(len(out_a), np.int64)]).astype(np.int64),
            "other": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(out_b, pa.int64())]),
        })


def _intersections(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sizes of all pairwise intersections; columns that only one set has are left out."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    _, which, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = often[which] > 1
    row, which = row[shared], which[shared]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, (low, low + width))
        part = np.zeros((n, int(which[b - 1]) - low + 1), np.float32)
        part[row[a:b], which[a:b] - low] = 1
        common += part @ part.T
    return common


def exact_links(
    sets: DataFrame, similarity: float, sets_of: SetsOf = joined_hashes, widening: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Number of links per id, and the classes that they form.

    ``sets``: ``root`` (the group to compare), ``id`` (unique), ``hashes`` (distinct 64-bit hashes,
    joined, or what ``sets_of`` makes them of, in ``widening`` times the bytes). Gives ``id, links`` of ids with links and ``id, root`` of the classes.
    """
    sizes = sets.groupBy("root").agg(F.count("*").alias("_sets"), (F.sum(F.octet_length("hashes")) * widening).alias("_bytes"))
    blocks = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_bytes") / BLOCK_BYTES))
    rows = in_block_pairs(sets.join(staged(sizes.where("_sets > 1"), "set-groups"), "root"), "root", blocks)
    found = staged(
        rows.select("root", "i", "j", "block", "id", "hashes")
        .repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "id")
        .mapInArrow(partial(_exact, similarity=similarity, sets_of=sets_of), "id bigint, links bigint, other bigint")
        .where("links > 0 OR other IS NOT NULL"),
        "links",
    )
    links = found.groupBy("id").agg(F.sum("links").cast("bigint").alias("links")).where("links > 0")
    return links, components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
