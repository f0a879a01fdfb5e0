"""Texts built from many rows, such as one report per session: rows of lines that carry their order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import bind

#: What orders the lines of a document.
ORDER = ("section", "place", "pos")
#: A text of up to this many lines is one row; a longer one comes in parts of that size.
PART_BITS = 12
#: Places in a section: its title, its lines, and what closes it.
TITLE, LINES, CLOSING = 0, 1, 2


@dataclass(frozen=True)
class Section:
    """A titled block. ``lines`` has the key, ``pos`` (whole, unique per key) and ``line``."""

    title: str | None
    lines: DataFrame
    #: Whether a blank line follows the title.
    gap: bool = False


def assemble(
    key: str,
    sections: Sequence[Section],
    opening: Sequence[str] = (),
    keys: DataFrame | None = None,
) -> DataFrame:
    """``key, section, place, pos, line``: the lines of each key's document.

    A document is its lines in the order of ``ORDER``, joined by newlines; :func:`write_documents`
    writes it so. A section starts with its title and ends with a blank line, and is left out for keys
    without lines in it. Only keys that occur in a section, or in ``keys``, get a document. Every
    line is a row, so a document may be of any length: no task ever holds one.
    """
    number = F.lit(0).cast("int")
    rows = reduce(DataFrame.unionByName, [
        section.lines.select(
            key, (number + i).alias("section"), F.lit(LINES).alias("place"),
            F.col("pos").cast("bigint").alias("pos"), "line",
        )
        for i, section in enumerate(sections)
    ])
    present = rows.select(key, "section").distinct()
    # What stands around a section's lines: title, blank line below it, closing blank line.
    frames = {
        i: [(TITLE, 0, section.title)] * (section.title is not None)
        + [(TITLE, 1, "")] * (section.title is not None and section.gap) + [(CLOSING, 0, "")]
        for i, section in enumerate(sections)
    }
    frame = F.coalesce(*[
        F.when(F.col("section") == i, F.array(*[
            F.struct(F.lit(place).alias("place"), F.lit(pos).cast("bigint").alias("pos"), F.lit(line).alias("line"))
            for place, pos, line in lines
        ]))
        for i, lines in frames.items()
    ])
    whole = rows.unionByName(
        present.select(key, "section", F.explode(frame).alias("_f")).select(key, "section", "_f.*")
    )
    if opening:
        everyone = present.select(key)
        if keys is not None:
            everyone = everyone.unionByName(keys.select(key))
        first = F.posexplode(F.array(*map(F.lit, opening)))
        whole = whole.unionByName(everyone.distinct().select(key, first.alias("_at", "line")).select(
            key, F.lit(-1).alias("section"), F.lit(TITLE).alias("place"), F.col("_at").cast("bigint").alias("pos"), "line",
        ))
    return whole


def document_texts(rows: DataFrame, key: str, part_bits: int = PART_BITS) -> DataFrame:
    """``key, part, text``: each key's document as text, every line of it ended by a newline.

    ``rows`` are those of :func:`assemble`. A document of up to ``2**part_bits`` lines is one text, part
    0. A longer one comes in parts, each the lines of a section whose ``pos`` share their upper bits;
    joined in the order of ``part`` they are the document, so no task has to hold one of unbounded length.
    """
    at = (F.col("section") + 1) * (CLOSING + 1) + F.col("place")
    pages = rows.select(
        key, at.cast("bigint").alias("_at"), F.shiftright("pos", part_bits).alias("_page"), "pos", "line"
    ).groupBy(key, "_at", "_page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_lines"))
    pages = bind(pages, "_p", F.struct(
        F.array_join("_lines.line", "\n").alias("text"), F.size("_lines").alias("lines")
    )).select(key, "_at", "_page", "_p")
    # Text and count are bound together, so that the lengths come from the same shuffle.
    lengths = pages.groupBy(F.col(key).alias("_key")).agg(
        F.sum(F.when(F.col("_p.text").isNotNull(), F.col("_p.lines"))).alias("_length")
    )
    part = F.when(
        F.col("_length") > (1 << part_bits), F.shiftleft("_at", 57) + F.coalesce("_page", F.lit(0))
    ).otherwise(0)
    return (
        pages.join(lengths, F.col(key).eqNullSafe(F.col("_key")))
        .groupBy(key, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_page", "_p.text"))).alias("_texts"))
        .select(key, "part", F.concat(F.array_join("_texts.text", "\n"), F.lit("\n")).alias("text"))
    )


def write_documents(rows: DataFrame, key: str, folder: str, order: Sequence[str] = ORDER) -> None:
    """Write each key's document as text files in a folder of its own.

    ``rows`` has the key, ``order`` and ``line``. Rows are dealt to tasks by ranges of that order, so a
    long document is written by several tasks: its files, in the order of their names, are its text.
    The folder's name is the key, URL-encoded.
    """
    named = rows.withColumn("_name", F.url_encode(F.col(key).cast("string")))
    sort = ["_name", *order]
    (
        named.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .select(F.col("_name").alias(key), F.col("line").alias("value"))
        .write.mode("overwrite").partitionBy(key).text(folder)
    )
