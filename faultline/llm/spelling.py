"""Spelling variants: words one edit apart, found by a relational trie frontier.

The words form a trie, kept as a table of edges: node, label, child. A node is named by the hash of
its prefix. Chains without a branch or a word's end are one edge, so that the number of levels follows
the branches on a word's path, not its length. States (word, position, node, edits) are joined with
the edges level by level: a state of no edits follows every edge, with the one edit inside the label or
without; a state of one edit follows only what the word spells. States that stand at the end of a word,
with their own word used up, are neighbours.

A single edit leaves one half of a word as it is. Two tries are searched, of the words and of the
reversed words; in each a word begins below its first half, so that no state branches near the root.

Joins are salted: a node that many words pass has its edges in several copies, and a state joins one of
them. Each level is written to the shared folder, and the one before it deleted. A hash shared by
two prefixes can only add states, which the exact check of each pair drops; it loses none. No join
broadcasts a side: all of them grow with the vocabulary, and Spark takes them for far smaller.

Defined results: a null text has no words; a null id counts as empty text; repeated rows count each;
further columns are ignored; an empty table gives an empty result. A word's length is not bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.staging import dropped, staged

#: A word, before lower-casing A-Z.
RUN = "([A-Za-zÀ-ÿ]+)"
#: One occurrence in this many loses a letter, by the checksum of its document and itself.
TYPO_EVERY = 199
#: How much more frequent the form of a word is.
FORM_TIMES = 5
#: Words below a node that one copy of its edges serves.
SALT_WORDS = 5000

_PREFIXES = "side int, whole bigint, place int, node bigint, follows int"
_PREFIX_SCHEMA = pa.schema([
    ("side", pa.int32()), ("whole", pa.int64()), ("place", pa.int32()), ("node", pa.int64()), ("follows", pa.int32()),
])


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n`` of all words of the documents, typing slips included."""
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc")
    runs = docs.select(ids, F.translate("text", upper, lower).alias("text")).select("_doc", run.alias("run"))
    h = F.crc32(F.concat("_doc", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("_h", h).withColumn("_at", (F.col("_h") % F.length("run")).cast("int"))
    without = F.concat(F.expr("substring(run, 1, _at)"), F.expr("substring(run, _at + 2)"))
    word = F.when(F.col("_h") % TYPO_EVERY == 0, without).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _dealt(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of a join that deals both by key, never through the driver.

    Spark sizes a written table by its packed files, and the prefixes of words as one row per word.
    """
    return frame.hint("merge")


def _sides(vocabulary: DataFrame) -> DataFrame:
    """Every word and its reverse, and how much of each is left as it is before the edit."""
    half = F.floor((F.length("word") + 1) / 2).cast("int")
    first = vocabulary.select(F.lit(0).alias("side"), F.col("word").alias("spelt"), half.alias("kept"))
    rest = (F.length("word") - half).cast("int")
    return first.unionAll(vocabulary.select(F.lit(1), F.reverse("word"), rest))


def _prefixes(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefixes of ``least`` letters or more: their hashes and the letter that follows, or -1."""
    for batch in batches:
        sides = np.asarray(batch.column(0))
        for first, last, data, offsets in words.blocks(batch.column(1)):
            side, sums = sides[first:last], words.prefix_hash(data)
            # Two bytes at most make a letter; the second of them begins with the bits 10.
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            letters = np.searchsorted(begins, offsets)
            code = data[begins].astype(np.int32)
            wide = np.flatnonzero(code > 127)
            code[wide] = ((code[wide] & 31) << 6) | (data[begins[wide] + 1] & 63)
            sizes = np.diff(letters)
            word = np.repeat(np.arange(last - first), sizes)
            place = np.arange(len(begins)) - letters[word] + 1
            ends = np.append(begins[1:], len(data))
            ends_word = place == sizes[word]
            follows = np.where(ends_word, np.int32(-1), np.append(code[1:], np.int32(-1)))
            node = words.mix(words.span_hash(sums, offsets[word], ends) + side[word].astype(np.uint64))
            whole = node[letters[1:] - 1][word]
            some = place >= least
            yield pa.record_batch([
                pa.array(side[word][some], pa.int32()), pa.array(whole[some].view(np.int64)),
                pa.array(place[some], pa.int32()), pa.array(node[some].view(np.int64)),
                pa.array(follows[some], pa.int32()),
            ], schema=_PREFIX_SCHEMA)


def _trie(sides: DataFrame, least: int) -> DataFrame:
    """The nodes on the path of each word: where it branches, where words end, and its root."""
    def prefixes():
        return sides.select("side", "spelt").mapInArrow(partial(_prefixes, least), _PREFIXES)

    nodes = prefixes().groupBy("node").agg(
        F.count("*").alias("below"), F.min("follows").alias("_low"), F.max("follows").alias("_high"),
        F.min("place").alias("_place"),
    ).where((F.col("_low") == -1) | (F.col("_low") != F.col("_high")) | (F.col("_place") == least))
    nodes = nodes.select(
        "node", (F.col("_low") == -1).alias("is_word"), F.ceil(F.col("below") / SALT_WORDS).cast("int").alias("salts")
    )
    paths = prefixes().select("side", "whole", "place", "node").join(_dealt(nodes), "node")
    return paths.join(_dealt(_ends(sides)), ["side", "whole"])


def _ends(sides: DataFrame) -> DataFrame:
    """The words by the node that they end in."""
    return sides.select("side", "spelt", "kept").mapInArrow(_named, "side int, whole bigint, spelt string, kept int")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = np.asarray(batch.column(0))
        for first, last, data, offsets in words.blocks(batch.column(1)):
            hashes = words.span_hash(words.prefix_hash(data), offsets[:-1], offsets[1:])
            whole = words.mix(hashes + sides[first:last].astype(np.uint64)).view(np.int64)
            n = last - first
            yield pa.record_batch(
                [batch.column(0).slice(first, n), pa.array(whole), batch.column(1).slice(first, n),
                 batch.column(2).slice(first, n)], names=["side", "whole", "spelt", "kept"],
            )


def _salt(salts: Column) -> Column:
    return F.pmod(F.xxhash64("spelt"), salts).cast("int")


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further, and the node of the word found, if any."""
    # After its edit a word follows one edge at most, known by its first letter.
    rest = F.expr("substring(spelt, place + 1, 1)")
    spent = states.where("edits = 1").withColumn("begins", rest).join(_dealt(edges), ["node", "salt", "begins"]).drop("begins")
    free = states.where("edits = 0").join(_dealt(edges.drop("begins")), ["node", "salt"])
    joined = free.unionByName(spent).withColumn("_size", F.length("label")).withColumn(
        "_rest", F.expr("substring(spelt, place + 1, _size + 1)")
    ).withColumn("_held", F.expr("greatest(kept - place, 0)")).withColumn(
        "_same", F.expr("substring(_rest, 1, _size) = label")
    )
    may = "edits = 0 AND NOT _same AND _size > _held AND substring(_rest, 1, _held) = substring(label, 1, _held)"

    def edited(taken: str) -> str:
        """One edit makes the next ``taken`` letters of the word the label."""
        return (
            f"CASE WHEN {may} AND length(_rest) >= {taken} "
            f"AND levenshtein(label, substring(_rest, 1, {taken}), 1) = 1 "
            f"THEN struct(place + {taken} AS place, 1 AS edits) END"
        )

    same = "CASE WHEN _same THEN struct(place + _size AS place, edits AS edits) END"
    moves = f"filter(array({same}, {edited('_size')}, {edited('_size - 1')}, {edited('_size + 1')}), m -> m IS NOT NULL)"
    moved = joined.withColumn("_move", F.explode(F.expr(moves))).select(
        "side", "spelt", "kept", F.col("_move.place").alias("place"), F.col("child").alias("node"),
        F.col("_move.edits").alias("edits"), _salt(F.col("child_salts")).alias("salt"),
        # At the end of another word: nothing is left, or one letter to take away.
        (F.col("is_word") & (F.length("spelt") - F.col("_move.place") + F.col("_move.edits") == 1)).alias("found"),
    )
    return moved.where("found OR edits = 0 OR place < length(spelt)")


def neighbours(vocabulary: DataFrame, least_length: int = 6) -> DataFrame:
    """``word, near``: all ordered pairs of words that one edit separates. ``vocabulary`` is a written table."""
    sides = _sides(vocabulary)
    least = least_length // 2
    paths = staged(_trie(sides, least), "spelling-paths")
    along = Window.partitionBy("side", "whole").orderBy("place")
    above = [F.lag(c).over(along).alias(a) for c, a in (("node", "parent"), ("place", "_above"), ("salts", "_salts"))]
    edges = paths.select("*", *above).where("parent IS NOT NULL").select(
        F.col("parent"), F.expr("substring(spelt, _above + 1, place - _above)").alias("label"),
        F.col("node").alias("child"), "is_word", F.col("salts").alias("child_salts"), "_salts",
    ).distinct()
    edges = edges.select(
        F.col("parent").alias("node"), F.explode(F.expr("sequence(0, _salts - 1)")).alias("salt"),
        "label", F.substring("label", 1, 1).alias("begins"), "child", "is_word", "child_salts",
    )
    edges = staged(edges, "spelling-edges")
    states = paths.withColumn("_next", F.lead("place").over(along)).where("place <= kept AND _next > kept").select(
        "side", "spelt", "kept", "place", "node", F.lit(0).alias("edits"), _salt(F.col("salts")).alias("salt")
    )
    found, before = [], None
    alive = "edits = 0 OR place < length(spelt)"
    while True:
        after = staged(_level(states, edges), "spelling-states")
        if before is not None:
            dropped(before)
        left, hits = after.agg(F.count_if(F.expr(alive)), F.count_if("found")).head()
        if hits:
            found.append(staged(after.where("found").select("side", "spelt", F.col("node").alias("whole")), "spelling-found"))
        if not left:
            dropped(after)
            break
        states = after.where(alive).drop("found")
        before = after
    ends = _ends(sides).select("side", "whole", F.col("spelt").alias("_near"))
    pairs = found[0] if found else paths.select("side", "spelt", "whole").limit(0)
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    turned = [F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(a) for c, a in (("spelt", "word"), ("_near", "near"))]
    pairs = pairs.join(_dealt(ends), ["side", "whole"]).select("side", *turned)
    # The reversed trie gives only what the other cannot: pairs that differ in the first half.
    half = "floor((length(word) + 1) / 2)"
    fresh = F.expr(f"side = 0 OR left(word, {half}) != left(near, {half})")
    pairs = pairs.where(fresh & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")
    pairs = staged(pairs, "spelling-pairs")
    dropped(paths, edges, *found)
    return pairs


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words.

    A word's form is its most frequent neighbour, ties by code points, if it is ``FORM_TIMES`` as
    frequent; its root is the last of the forms from the word on.
    """
    counts = staged(vocabulary(docs, least_length, least_count), "spelling-words")
    pairs = neighbours(counts, least_length)
    near = counts.select(F.col("word").alias("near"), F.col("n").alias("_n"))
    best = pairs.join(_dealt(near), "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("_less"), "near")).alias("_best")
    )
    out = counts.join(_dealt(best), "word", "left").withColumn(
        "_is", F.col("_best").isNotNull() & (-F.col("_best._less") >= FORM_TIMES * F.col("n"))
    ).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("_is"), F.col("_best.near")).alias("form"), F.when(F.col("_is"), -F.col("_best._less")).alias("form_n"),
    )
    out = staged(out, "spelling-forms")
    dropped(pairs, counts)
    return out.join(_dealt(_roots(out)), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of every word that has one; the way doubles each round, and counts grow along it."""
    roots, own = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), None
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        after = roots.join(_dealt(further), "root", "left").select(
            "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")
        )
        after = staged(after, "spelling-roots")
        if own is not None:
            dropped(own)
        roots, own = after.drop("_moved"), after
        if after.where("_moved").isEmpty():
            return roots
