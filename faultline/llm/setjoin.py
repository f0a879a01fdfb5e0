"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles. In every run each set follows paths: at a node a shared random
choice names one or two positions of the sets' minhash sketches, and sets go to the child named by
their shingle there, so that sets of similarity ``s`` stay together with chance ``s``. Nodes with few
sets are compared by brute force, larger ones are split again; runs are repeated until a link at the
threshold is missed with negligible chance. A node that no choice splits, since its sets are alike,
is compared in pairs of blocks.

Nodes yield spanning forests of likely pairs, not pairs; exact Jaccard similarity decides within
their components (see ``similar``). So a link is found if any run finds a path between its ends, and
links are counted, not listed.

Defined results: a text without words (null, empty, signs alone) is a class of its own; texts with equal
shingle sets are copies, counted in ``n_copies``, not in ``n_links``; shorter texts than a shingle
are a set of one; rows of null ``doc_id`` are compared like others, and a class of such rows alone has
a null ``class_id``; repeated rows are copies; further columns are ignored; an empty table gives an
empty result. Sets are named by 64 bits of a hash of their content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.components import components
from faultline.llm.similar import BLOCK_SETS, SKETCH, agreeing, bitmap, exact_links, in_bitmap, likely_pairs, minima, set_ids
from faultline.llm.rows import keyed, one_per_group
from faultline.llm.staging import dropped, staged

SHINGLE, SIMILARITY = 5, 0.8
#: Missing a link at 0.8 in all of 12 runs has a chance of 1e-7 after one split, 1e-4 after four.
RUNS = 12
#: A child that holds more of its parent than this was not split by the choice.
SPLITS = 0.5


def choices(run: int, similarity: float = SIMILARITY) -> list[int]:
    """Sketch positions chosen at the root of a run: one, and a second as often as keeps paths alive."""
    extra = 1 / similarity - 1
    count = 1 + (int((run + 1) * extra) > int(run * extra))
    seeds = words.mix(np.array([run * 2 + 1, run * 2 + 2], np.uint64))
    first = int(seeds[0] % np.uint64(SKETCH))
    return [first, (first + 1 + int(seeds[1] % np.uint64(SKETCH - 1))) % SKETCH][:count]


def _sets(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words.distinct_per_text(*words.shingle_hashes(h, offsets, SHINGLE))


@words.tidy
def _sketched(batches: Iterator[pa.RecordBatch], runs: int, similarity: float) -> Iterator[pa.RecordBatch]:
    chosen = [(run, at) for run in range(runs) for at in choices(run, similarity)]
    places = np.array([at for _, at in chosen])
    salts = words.mix(np.array([run + 1 for run, _ in chosen], np.uint64))
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = words.Words(data, offsets)
            h, bounds = _sets(found.hashes, found.offsets)
            least = minima(h, bounds)
            roots = words.mix((least[:, places] ^ salts) + places.astype(np.uint64)).view(np.int64)
            rows = last - first
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(first, rows), "own_key": batch["own_key"].slice(first, rows),
                "id": set_ids(h, bounds),
                "n": np.diff(bounds),
                "roots": pa.FixedSizeListArray.from_arrays(pa.array(roots.ravel()), len(places)).cast(pa.list_(pa.int64())),
                "sketch": pa.array([r.tobytes() for r in (least >> np.uint64(32)).astype(np.uint32)], pa.binary()),
            })


@words.tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in words.blocks(batch["text"]):
            found = words.Words(data, offsets)
            h, bounds = _sets(found.hashes, found.offsets)
            yield pa.record_batch({
                "id": set_ids(h, bounds),
                "hashes": pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            })


def _among(keys: DataFrame):
    """A filter of rows by ``own_key`` that lets all of ``keys`` pass and few others, so that texts stay where they are."""
    given = bitmap(keys, "own_key")

    def passes(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(given.value, keys.to_numpy()))

    return F.pandas_udf(passes, "boolean")("own_key")


def _forests(sets: DataFrame, similarity: float, bucket: int, deepest: int) -> DataFrame:
    """Forests of likely pairs from the nodes of all runs; ``sets``: ``id, roots, sketch``."""
    level = sets.where("n > 0").select("id", F.explode("roots").alias("bucket"))
    found, parents = None, None
    for depth in range(deepest + 1):
        sizes = staged(level.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "node-sizes")
        nodes = level.join(sizes, "bucket")
        nodes = staged(nodes.join(sets.select("id", "sketch"), "id"), "nodes")
        if depth == 0:
            nodes = nodes.withColumn("parent_size", F.lit(None).cast("bigint"))
        else:
            nodes = nodes.join(parents, "bucket")
        split = (F.col("size") > bucket) & (
            F.col("parent_size").isNull() | (F.col("size") <= SPLITS * F.col("parent_size"))
        )
        if depth == deepest:
            split = F.lit(False)
        pairs = staged(
            likely_pairs(nodes.where(~split).select("bucket", "size", "id", "sketch"), agreeing(similarity)).distinct(), "likely"
        )
        found = pairs if found is None else found.union(pairs)
        large = nodes.where(split)
        if depth == deepest or large.isEmpty():
            break
        # One child per choice; the second is made as often as keeps the paths of a link alive.
        extra = 1 / similarity - 1
        children = F.when(
            F.pmod(F.xxhash64(F.lit(depth), "bucket"), F.lit(1000)) < int(1000 * extra), F.array(F.lit(0), F.lit(1))
        ).otherwise(F.array(F.lit(0)))
        next_level = large.withColumn("child", F.explode(children)).select(
            "id", F.xxhash64("bucket", "child", F.expr(
                f"substring(sketch, 4 * CAST(pmod(xxhash64(bucket, child), {SKETCH}L) AS INT) + 1, 4)")).alias("bucket"),
            F.col("size").alias("parent_size"),
        )
        next_level = staged(next_level, "children")
        parents = next_level.groupBy("bucket").agg(F.max("parent_size").alias("parent_size"))
        parents = staged(parents, "parents")
        level = next_level.select("id", "bucket")
    return found


def join(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, set_id`` of every row.

    ``class_id`` is the smallest ``doc_id`` of all texts joined by links; ``n_links`` the number of
    different shingle sets of at least the similarity; ``n_copies`` the rows of the same set.
    """
    return _joined(docs, **settings).select("doc_id", "class_id", "n_links", "n_copies", F.col("id").alias("set_id"))


def _joined(docs: DataFrame, similarity: float = SIMILARITY, runs: int = RUNS, bucket: int = BLOCK_SETS,
            deepest: int = 6) -> DataFrame:
    """The columns of ``join``, with ``own_key``, ``n`` shingles and the ``root`` of the class."""
    texts = keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(texts.mapInArrow(
        partial(_sketched, runs=runs, similarity=similarity),
        f"doc_id {kind}, own_key bigint, id bigint, n bigint, roots array<bigint>, sketch binary",
    ), "sketches")
    # Equal sets have equal sketches: any one stands for all, and copies meet in every task first.
    sets = staged(rows.groupBy("id").agg(
        F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"),
        F.min("doc_id").alias("first_doc"), F.min("own_key").alias("own_key"), F.count("*").alias("n_copies"),
    ), "sets")
    likely = components(_forests(sets, similarity, bucket, deepest))
    members = staged(likely.join(sets.select("id", "own_key"), "id"), "members")
    # What else passes is of no member, which the join by id leaves out, or a copy of one.
    hashes = texts.where(_among(members)).mapInArrow(_hashed, "id bigint, hashes binary").dropDuplicates(["id"])
    compared = staged(members.join(hashes, "id").select("root", "id", "hashes"), "compared-sets")
    links, classes = exact_links(compared, similarity)
    dropped(compared)
    firsts = classes.join(sets.select("id", "first_doc"), "id")
    firsts = firsts.join(firsts.groupBy("root").agg(F.min("first_doc").alias("class_id")), "root")
    linked = links.select("id", "links").join(firsts.select("id", "root", "class_id"), "id")
    named = staged(sets.select("id", "first_doc", "n_copies").join(linked, "id", "left").select(
        "id", "n_copies", F.coalesce("root", "id").alias("root"), F.coalesce("class_id", "first_doc").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
    ), "named-sets")
    own = F.col("n") == 0
    return rows.select("doc_id", "own_key", "id", "n").join(named, "id").select(
        "doc_id", "own_key", "root", "n", "id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links",
        F.when(own, 1).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"),
    )


def one_per_class(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` of each class, of the smallest id, with all its columns; rows without words stay."""
    found = _joined(docs, **settings).where("n > 0").select("doc_id", "own_key", "root")
    return one_per_group(docs, staged(found, "classed-rows"), ["root"], F.min)
