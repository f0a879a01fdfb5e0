"""Execution plans: suggested commands, checked and rated, for a list of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.policy import ALLOWED, ARGUMENT_NOT_ALLOWED, validate_commands

LOCALHOST = "localhost"


class CommandPlans(NamedTuple):
    """``commands``: one row per planned command. ``summary``: one row per plan."""

    commands: DataFrame
    summary: DataFrame


def create_plans(
    commands: DataFrame,
    policy: DataFrame | None,
    hosts: Sequence[str] | None = None,
    auto_approve: bool = False,
) -> CommandPlans:
    """Plans from ``plan_id, command_idx, category, description, command``.

    Every command goes to all hosts of its plan: those given here, or the plan's own in a column
    ``targets array<string>``, else this machine. Without a policy nothing is checked and every
    risk is unknown. A disallowed argument makes the plan invalid; its row says which.
    """
    if "targets" not in commands.columns:
        targets = F.array(*[F.lit(h) for h in (hosts or [LOCALHOST])])
        commands = commands.withColumn("targets", targets)
    commands = commands.withColumn(
        "targets", F.when(F.size("targets") > 0, F.col("targets"))
        .otherwise(F.array(F.lit(LOCALHOST))),
    )
    if policy is None:
        checked = commands.withColumn("verdict", F.lit(None).cast("string")).withColumn(
            "risk_level", F.lit(None).cast("string")
        )
    else:
        checked = validate_commands(commands, policy, "command")
    risk = F.when(F.col("verdict") == ALLOWED, F.col("risk_level"))
    planned = checked.select(
        "plan_id", "command_idx", "category", "description", "command",
        F.col("command").alias("validated_command"), "targets", "verdict",
        F.coalesce(risk, F.lit("unknown")).alias("risk_level"),
    ).withColumn("requires_approval", F.col("risk_level").isin("medium", "high", "unknown"))
    summary = planned.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("total_commands"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
        (F.bool_or("requires_approval") & F.lit(not auto_approve)).alias("requires_approval"),
        F.coalesce(F.bool_or(F.col("verdict") == ARGUMENT_NOT_ALLOWED), F.lit(False))
        .alias("invalid"),
        F.sum(F.size("targets").cast("bigint")).alias("executions"),
    )
    return CommandPlans(planned, summary)
