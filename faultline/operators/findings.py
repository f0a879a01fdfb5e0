"""Findings in command output, and the facts and hypotheses that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import bind

# Kinds of finding and the words that show them, in order
FINDING_WORDS = {
    "timeout": ["timeout", "timed out", "超时"],
    "connection_refused": ["connection refused", "连接被拒绝"],
    "dns_failure": ["no such host", "dns", "解析失败", "NXDOMAIN"],
    "high_latency": ["time=", "latency", "延迟"],
    "packet_loss": ["packet loss", "丢失", "100% packet loss"],
}

# What a kind of finding establishes
FINDING_FACTS = {
    "timeout": ("存在超时问题", 0.8),
    "connection_refused": ("连接被拒绝", 0.9),
    "dns_failure": ("存在DNS问题", 0.8),
}
OUTPUT_SOURCE = "命令输出"
MODEL_SOURCE = "AI分析"
MODEL_EVIDENCE = "AI分析识别的可能原因"
LEADING_CAUSES = 3


def extract_findings(outputs: DataFrame, output: str = "output") -> DataFrame:
    """One row per finding: the input's columns but ``output``, then ``kind, keyword, finding``.

    Per kind, the first of its words that occurs in the text counts; case does not matter.
    """
    others = [c for c in outputs.columns if c != output]
    lowered = F.col("_lowered")
    found = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"),
            F.coalesce(*[F.when(lowered.contains(w.lower()), w) for w in words]).alias("keyword"),
        )
        for kind, words in FINDING_WORDS.items()
    ])
    rows = bind(outputs, "_lowered", F.lower(output)).select(*others, F.explode(found).alias("_f"))
    return rows.filter(F.col("_f.keyword").isNotNull()).select(
        *others, "_f.kind", "_f.keyword",
        F.concat(F.lit("检测到"), "_f.kind", F.lit(": "), "_f.keyword").alias("finding"),
    )


def findings_to_facts(findings: DataFrame) -> DataFrame:
    """The facts findings establish: ``fact, source, confidence`` next to the other columns.

    High latency and packet loss establish none.
    """
    others = [c for c in findings.columns if c not in ("kind", "keyword", "finding")]

    def chosen(i: int) -> Column:
        return F.coalesce(
            *[F.when(F.col("kind") == kind, F.lit(fact[i])) for kind, fact in FINDING_FACTS.items()]
        )

    return findings.filter(F.col("kind").isin(*FINDING_FACTS)).select(
        *others, chosen(0).alias("fact"), F.lit(OUTPUT_SOURCE).alias("source"),
        chosen(1).alias("confidence"),
    )


def initial_facts(analyses: DataFrame, key: str = "session_id") -> DataFrame:
    """The fact every analysis starts with: its problem type at the model's confidence."""
    return analyses.select(
        key, F.concat(F.lit("问题类型: "), "problem_type").alias("fact"),
        F.lit(MODEL_SOURCE).alias("source"), "confidence",
    )


def initial_hypotheses(analyses: DataFrame, key: str = "session_id") -> DataFrame:
    """``hypothesis_id, hypothesis, evidence, confidence`` of the leading causes, each less sure
    than the one before."""
    causes = F.slice("possible_causes", 1, LEADING_CAUSES)
    rows = analyses.select(
        key, "confidence", F.posexplode(causes).alias("hypothesis_id", "hypothesis")
    )
    weight = F.lit(0.9) - F.col("hypothesis_id") * F.lit(0.1)
    return rows.select(
        key, F.col("hypothesis_id").cast("bigint").alias("hypothesis_id"), "hypothesis",
        F.array(F.lit(MODEL_EVIDENCE)).alias("evidence"),
        (F.col("confidence") * weight).alias("confidence"),
    )
