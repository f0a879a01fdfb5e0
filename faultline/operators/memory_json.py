"""What a session remembers as one JSON document, out of the tables and back into them.

A document has entries, context, facts, hypotheses and decisions. It is written as ordered lines, one
per record and per piece of evidence, so that its length has no bound; joined by newlines, or by nothing,
the lines are the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.formatting import iso_datetime

#: What orders the lines of a document.
ORDER = ("section", "place", "pos", "sub", "item")

_SECTIONS = ("entries", "context", "facts", "hypotheses", "decisions")
_OBJECTS = ("context", "facts")
_DOCUMENT = """struct<
  entries: array<struct<id: bigint, timestamp: string, round: int, action_type: string,
    action_description: string, observation: string, result_summary: string,
    metadata: map<string, string>>>,
  context: map<string, variant>,
  facts: map<string, struct<source: string, confidence: double, timestamp: string>>,
  hypotheses: array<struct<id: bigint, hypothesis: string, evidence: array<string>,
    confidence: double, status: string, created_at: string>>,
  decisions: array<struct<decision: string, reasoning: string, alternatives: array<string>,
    timestamp: string>>
>"""


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _inside(json: Column) -> Column:
    """A JSON object or array without its brackets."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def memory_documents(
    entries: DataFrame,
    context: DataFrame,
    facts: DataFrame,
    hypotheses: DataFrame,
    evidence: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """``session_id, section, place, pos, sub, item, line``: the lines of each session's document.

    ``context`` has ``session_id, position, key, value``, the value as JSON; ``facts`` and ``hypotheses``
    are the folded tables, with ``timestamp`` and ``created_at``; ``evidence`` is that of
    :func:`faultline.operators.memory.hypothesis_evidence`. Records stand in the order of their id,
    position or ``seq``. Every session that any table names gets a document with all five sections.
    """
    time = iso_datetime("timestamp").alias("timestamp")
    record = F.struct(
        "id", time, "round", "action_type", "action_description", "observation", "result_summary", "metadata"
    )
    fact = F.struct("source", "confidence", time)
    choice = F.struct("decision", "reasoning", "alternatives", time)
    named = _json(F.create_map("key", F.lit(0)))
    tables = {
        "entries": (entries, F.col("id"), _json(record)),
        # ``"key":`` and the value as it is.
        "context": (context, F.col("position"), F.concat(F.substring(named, F.lit(2), F.length(named) - 3), "value")),
        "facts": (facts, F.col("position"), _inside(_json(F.create_map("fact", fact)))),
        "decisions": (decisions, F.col("seq"), _json(choice)),
    }
    number = {name: i for i, name in enumerate(_SECTIONS)}
    low, high = F.lit(-(1 << 62)), F.lit(1 << 62)

    def rows(table: DataFrame, section: str, pos: Column, sub, item, line: Column) -> DataFrame:
        return table.select(
            "session_id", F.lit(number[section]).alias("section"), F.lit(1).alias("place"),
            pos.cast("bigint").alias("pos"), sub.cast("bigint").alias("sub"), item.cast("int").alias("item"),
            line.alias("line"),
        )

    zero = F.lit(0)
    lines = [rows(t, name, pos, zero, zero, line) for name, (t, pos, line) in tables.items()]
    # A hypothesis opens, lists its evidence and closes.
    idea = _json(F.struct(
        F.col("hypothesis_id").alias("id"), "hypothesis", "confidence", "status",
        iso_datetime("created_at").alias("created_at"),
    ))
    ident = F.col("hypothesis_id")
    opened = F.concat(F.lit("{"), _inside(idea), F.lit(',"evidence":['))
    lines += [
        rows(hypotheses, "hypotheses", ident, low, zero, opened),
        rows(evidence, "hypotheses", ident, F.col("seq"), F.col("position"), _inside(_json(F.array("evidence")))),
        rows(hypotheses, "hypotheses", ident, high, zero, F.lit("]}")),
    ]
    whole = reduce(DataFrame.unionByName, lines)
    # A comma stands before every record but a section's first, and every evidence but a hypothesis' first.
    is_evidence = (F.col("section") == number["hypotheses"]) & (F.col("sub") > low) & (F.col("sub") < high)
    group = F.when(is_evidence, F.col("pos")).otherwise(-1)
    whole = whole.withColumn("_group", group).withColumn("_at", F.struct("pos", "sub", "item"))
    first = whole.groupBy("session_id", "section", "_group").agg(F.min("_at").alias("_first"))
    comma = (F.col("_at") != F.col("_first")) & ~((F.col("section") == number["hypotheses"]) & (F.col("sub") == high))
    whole = whole.join(first, ["session_id", "section", "_group"]).select(
        "session_id", *ORDER, F.when(comma, F.concat(F.lit(","), "line")).otherwise(F.col("line")).alias("line")
    )
    frame = []
    for name in _SECTIONS:
        opening, closing = "{}" if name in _OBJECTS else "[]"
        frame.append((number[name], 0, ("{" if name == _SECTIONS[0] else "") + f'"{name}":{opening}'))
        frame.append((number[name], 2, closing + ("}" if name == _SECTIONS[-1] else ",")))
    frame = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(p).alias("place"), F.lit(0).cast("bigint").alias("pos"),
                 F.lit(0).cast("bigint").alias("sub"), F.lit(0).alias("item"), F.lit(t).alias("line"))
        for s, p, t in frame
    ]))
    sessions = whole.select("session_id").distinct()
    return whole.unionByName(sessions.select("session_id", frame.alias("_f")).select("session_id", "_f.*"))


def memory_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables ``entries, context, facts, hypotheses, evidence, decisions`` of ``session_id, json``.

    They have the columns that :func:`memory_documents` takes; places in the document give positions.
    Sections that a document leaves out are empty.
    """
    read = documents.select("session_id", F.from_json("json", _DOCUMENT).alias("_d"))

    def each(section: str, *names: str) -> DataFrame:
        return read.select("session_id", F.posexplode(f"_d.{section}").alias("_at", *names))

    def time(column: str) -> Column:
        return F.col(column).cast("timestamp")

    place = F.col("_at").cast("bigint")
    ideas = each("hypotheses", "_r").select("session_id", "_r.*")
    return {
        "entries": each("entries", "_r").select(
            "session_id", "_r.id", time("_r.timestamp").alias("timestamp"), "_r.round", "_r.action_type",
            "_r.action_description", "_r.observation", "_r.result_summary", "_r.metadata",
        ),
        "context": each("context", "key", "_v").select(
            "session_id", place.alias("position"), "key", F.to_json("_v").alias("value")
        ),
        "facts": each("facts", "fact", "_r").select(
            "session_id", "fact", "_r.source", "_r.confidence", time("_r.timestamp").alias("timestamp"),
            place.alias("position"), place.alias("updated"),
        ),
        "hypotheses": ideas.select(
            "session_id", F.col("id").alias("hypothesis_id"), "hypothesis", "status", "confidence",
            F.size("evidence").cast("bigint").alias("evidence_count"), time("created_at").alias("created_at"),
        ),
        "evidence": ideas.select(
            "session_id", F.col("id").alias("hypothesis_id"), F.lit(-1).cast("bigint").alias("seq"),
            F.posexplode("evidence").alias("position", "evidence"),
        ),
        "decisions": each("decisions", "_r").select(
            "session_id", place.alias("seq"), "_r.decision", "_r.reasoning", "_r.alternatives",
            time("_r.timestamp").alias("timestamp"),
        ),
    }
