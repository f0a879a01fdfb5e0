"""Recorded command runs of diagnosis sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.findings import extract_findings, findings_to_facts

OUTPUT_CHARS = 1000
MEMORY_CHARS = 500
ENOUGH_COMMANDS = 3
SURE = 0.8


def succeeded() -> Column:
    return F.col("exit_code") == 0


def _position() -> Column:
    """Running order of a result: by command, then host."""
    return F.struct(F.col("command_idx").cast("bigint"), F.col("host_idx").cast("bigint"))


def stop_on_error(results: DataFrame) -> DataFrame:
    """Results up to and including the first failure of their session.

    The place of the first failure is one number per session, so no session is sorted in one task.
    """
    first_failure = results.groupBy("session_id").agg(
        F.min(F.when(~succeeded(), _position())).alias("_stop")
    )
    stops = first_failure.filter(F.col("_stop").isNotNull())
    joined = results.join(stops, "session_id", "left")
    return joined.filter(F.col("_stop").isNull() | (_position() <= F.col("_stop"))).select(
        *results.columns
    )


def session_rollup(
    results: DataFrame, stops_on_error: bool = True, entries: DataFrame | None = None
) -> DataFrame:
    """Per session: results, successes, errors, total duration and status.

    With the remembered ``entries`` also ``rounds_completed``, the last round that any of them names;
    a session of entries alone has no results.
    """
    runs = results.select(
        "session_id", F.lit(1).alias("_run"), succeeded().alias("_good"), "duration", F.lit(None).cast("int").alias("round")
    )
    if entries is not None:
        none = F.lit(None)
        runs = runs.unionByName(entries.select(
            "session_id", F.lit(0).alias("_run"), none.cast("boolean").alias("_good"),
            none.cast("double").alias("duration"), F.col("round").cast("int").alias("round"),
        ))
    rolled = (
        runs.groupBy("session_id")
        .agg(
            F.sum("_run").alias("results"),
            F.count_if(F.col("_good")).alias("successes"),
            F.count_if(~F.col("_good")).alias("errors"),
            F.sum("duration").alias("total_duration"),
            F.coalesce(F.max("round"), F.lit(0)).alias("rounds_completed"),
        )
        .withColumn(
            "status",
            F.when((F.col("errors") > 0) & F.lit(stops_on_error), "failed").otherwise("completed"),
        )
    )
    return rolled if entries is not None else rolled.drop("rounds_completed")


def pending_commands(suggested: DataFrame, executed: DataFrame) -> DataFrame:
    """Suggestions (``session_id, command_idx, command, ...``) whose command has not run yet."""
    done = executed.select("session_id", "command").distinct()
    return suggested.join(done, ["session_id", "command"], "left_anti").select(*suggested.columns)


def next_command(pending: DataFrame) -> DataFrame:
    """The first pending suggestion of each session."""
    others = [c for c in pending.columns if c != "session_id"]
    return (
        pending.groupBy("session_id")
        .agg(F.min_by(F.struct(*others), "command_idx").alias("_next"))
        .select("session_id", *[F.col(f"_next.{c}").alias(c) for c in others])
    )


def can_conclude(hypotheses: DataFrame, executed: DataFrame) -> DataFrame:
    """``session_id, can_conclude``: a confirmed hypothesis above 0.8, or enough commands run.

    Sessions that have neither hypotheses nor commands are not listed.
    """
    sure = (F.col("status") == "confirmed") & (F.col("confidence") > SURE)
    signs = hypotheses.select(
        "session_id", sure.alias("sure"), F.lit(0).cast("bigint").alias("ran")
    ).unionByName(
        executed.select(
            "session_id", F.lit(False).alias("sure"), F.lit(1).cast("bigint").alias("ran")
        )
    )
    return signs.groupBy("session_id").agg(
        (F.coalesce(F.bool_or("sure"), F.lit(False)) | (F.sum("ran") >= ENOUGH_COMMANDS))
        .alias("can_conclude")
    )


def successful_results(results: DataFrame) -> DataFrame:
    """Runs that succeeded, with their payload."""
    return results.filter(succeeded()).select(
        "session_id", "command", "exit_code", "stdout", "stderr", "duration", "host", "ts"
    )


def observations(results: DataFrame) -> DataFrame:
    """What a run leaves in memory: shortened output or error, and the memory entry's text.

    Adds ``success, output, error, observation, result_summary`` to the keys of the run.
    """
    success = succeeded()
    output = F.when(success, F.substring("stdout", 1, OUTPUT_CHARS))
    error = F.when(~success & (F.col("stderr") != ""), F.col("stderr"))
    return results.select(
        "session_id", "command_idx", "host_idx", "command", "host",
        success.alias("success"), output.alias("output"), error.alias("error"),
        F.substring(F.coalesce(output, error, F.lit("")), 1, MEMORY_CHARS).alias("observation"),
        F.concat(F.lit("成功: "), F.when(success, "True").otherwise("False")).alias(
            "result_summary"
        ),
    )


def observed_facts(results: DataFrame) -> DataFrame:
    """``session_id, seq, fact, source, confidence`` from the output and the failures of runs.

    ``seq`` puts the facts in the order in which the runs would have added them: a decimal that
    holds any command, any host and the kind of finding side by side.
    """
    wide = F.col("command_idx").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)")
    runs = results.withColumn("_run", wide + F.col("host_idx"))
    found = findings_to_facts(
        extract_findings(
            runs.filter(succeeded()).select(
                "session_id", "_run", F.col("stdout").alias("output")
            )
        )
    )
    failures = runs.filter(~succeeded() & (F.col("stderr") != "")).select(
        "session_id", "_run",
        F.concat(F.lit("命令执行失败: "), "stderr").alias("fact"),
        F.col("command").alias("source"), F.lit(1.0).alias("confidence"),
    )
    # A run adds at most one fact per kind of finding; the kinds come in this order.
    kind = F.when(F.col("fact") == "存在超时问题", 0).when(F.col("fact") == "连接被拒绝", 1)
    return found.unionByName(failures).select(
        "session_id",
        (F.col("_run") * 4 + kind.otherwise(2)).cast("decimal(38,0)").alias("seq"),
        "fact", "source", "confidence",
    )
