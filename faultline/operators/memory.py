"""What diagnosis sessions remember: entries, facts, hypotheses and decisions.

Every table has ``session_id`` and ``seq``, a bigint that is unique within the session and gives
the order of writing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.formatting import percent
from faultline.functions.text import empty_to_null
from faultline.operators.ordered import numbered
from faultline.plans.documents import Section, assemble
from faultline.schema import MEMORY

RECENT = 5
SUMMARY_RECENT = 10


def recent_entries(entries: DataFrame, count: int = RECENT) -> DataFrame:
    """The last ``count`` entries of each session."""
    latest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return (
        entries.withColumn("_n", F.row_number().over(latest))
        .filter(F.col("_n") <= count)
        .drop("_n")
    )


def entries_of_round(entries: DataFrame, number: int) -> DataFrame:
    return entries.filter(F.col("round") == number)


def upsert_facts(facts: DataFrame) -> DataFrame:
    """Facts (``session_id, seq, fact`` and what is stated of them, such as ``source, confidence,
    timestamp``) with the last writing of each.

    ``position`` is the ``seq`` of the first writing, which is where the fact stays listed.
    """
    return fold_facts(facts.withColumns({"position": F.col("seq"), "updated": F.col("seq")}).drop("seq"))


def fold_facts(facts: DataFrame) -> DataFrame:
    """One row per session and fact of folds of its writings: the first position and the last statement.

    Folds may be folded again, in any order and more than once.
    """
    stated = [c for c in facts.columns if c not in ("session_id", "fact", "position", "updated")]
    last = F.max_by(F.struct(*stated), "updated").alias("_last")
    return (
        facts.groupBy("session_id", "fact")
        .agg(F.min("position").alias("position"), F.max("updated").alias("updated"), last)
        .select("session_id", "fact", *[f"_last.{c}" for c in stated], "position", "updated")
    )


def number_hypotheses(created: DataFrame) -> DataFrame:
    """Hypotheses (``session_id, seq, hypothesis, evidence, confidence`` and, if known,
    ``created_at``) with their id, counted from 0 in each session."""
    known = ["created_at"] if "created_at" in created.columns else []
    return numbered(created, ["session_id"], "seq", "_n").select(
        "session_id", (F.col("_n") - 1).alias("hypothesis_id"), "seq", "hypothesis", "evidence",
        "confidence", *known,
    )


def _updates_of_known(hypotheses: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates written after the hypothesis they name; an earlier one knew no such hypothesis."""
    born = hypotheses.select("session_id", "hypothesis_id", F.col("seq").alias("_born"))
    return updates.join(born, ["session_id", "hypothesis_id"]).filter(
        F.col("seq") > F.col("_born")
    ).drop("_born")


def hypothesis_state(hypotheses: DataFrame, updates: DataFrame) -> DataFrame:
    """Hypotheses after their updates (``session_id, hypothesis_id, seq, status, confidence,
    new_evidence``).

    An update changes only what it states, and only a hypothesis that was there before it. The
    evidence itself, which has no bound, is in
    :func:`hypothesis_evidence`; here it is counted.
    """
    stated = empty_to_null(F.col("status"))
    folded = _updates_of_known(hypotheses, updates).groupBy("session_id", "hypothesis_id").agg(
        F.max_by(stated, F.when(stated.isNotNull(), F.col("seq"))).alias("_status"),
        F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias(
            "_confidence"
        ),
        F.sum(F.coalesce(F.size("new_evidence"), F.lit(0))).alias("_added"),
    )
    return hypotheses.join(folded, ["session_id", "hypothesis_id"], "left").select(
        "session_id", "hypothesis_id", "hypothesis",
        F.coalesce("_status", F.lit("active")).alias("status"),
        F.coalesce("_confidence", "confidence").alias("confidence"),
        (F.size("evidence") + F.coalesce("_added", F.lit(0))).alias("evidence_count"),
        *(["created_at"] if "created_at" in hypotheses.columns else []),
    )


def hypothesis_evidence(hypotheses: DataFrame, updates: DataFrame) -> DataFrame:
    """``session_id, hypothesis_id, seq, position, evidence``: one row per piece of evidence.

    Sorted by ``seq`` and ``position`` this is the evidence in the order it was added; the
    evidence a hypothesis was created with has seq -1.
    """
    own = hypotheses.select(
        "session_id", "hypothesis_id", F.lit(-1).cast("bigint").alias("seq"),
        F.posexplode("evidence").alias("position", "evidence"),
    )
    added = _updates_of_known(hypotheses, updates).select(
        "session_id", "hypothesis_id", "seq",
        F.posexplode("new_evidence").alias("position", "evidence"),
    )
    return own.unionByName(added)


def active_hypotheses(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "active")


def append_decisions(decisions: DataFrame, more: DataFrame) -> DataFrame:
    """The log of decisions (``session_id, seq, decision, reasoning, alternatives, timestamp``) with
    more."""
    return decisions.unionByName(more)


def hypothesis_mark(status: Column) -> Column:
    return F.when(status == "confirmed", "✓").when(status == "rejected", "✗").otherwise("?")


def memory_summary(
    facts: DataFrame, hypotheses: DataFrame, decisions: DataFrame, entries: DataFrame
) -> DataFrame:
    """``session_id, section, place, pos, line``: what each session remembers, as lines of a text.

    ``facts`` and ``hypotheses`` are the folded tables. Sections without rows are left out. The lines'
    order is that of :func:`faultline.plans.documents.assemble`.
    """
    certainty = F.concat(F.lit("置信度: "), percent(F.col("confidence")), F.lit(")"))
    sections = [
        Section("## 发现的事实", facts.select(
            "session_id", F.col("position").alias("pos"),
            F.concat(F.lit("- "), "fact", F.lit(" (来源: "), "source", F.lit(", "), certainty)
            .alias("line"),
        )),
        Section("## 假设", hypotheses.select(
            "session_id", F.col("hypothesis_id").alias("pos"),
            F.concat(F.lit("- ["), hypothesis_mark(F.col("status")), F.lit("] "), "hypothesis",
                     F.lit(" ("), certainty).alias("line"),
        )),
        Section("## 做出的决策", decisions.select(
            "session_id", F.col("seq").alias("pos"),
            F.concat(F.lit("- "), "decision").alias("line"),
        )),
        Section("## 最近操作", recent_entries(entries, SUMMARY_RECENT).select(
            "session_id", F.col("id").alias("pos"),
            F.concat(F.lit("- Round "), F.col("round").cast("string"), F.lit(": ["),
                     "action_type", F.lit("] "), "action_description").alias("line"),
        )),
    ]
    return assemble("session_id", sections, opening=["# 诊断记忆摘要", ""])
