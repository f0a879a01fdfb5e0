"""Queries over model responses, findings, sessions and their reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import moment
from faultline.functions.text import bind
from faultline.operators.findings import (
    extract_findings, findings_to_facts, initial_facts, initial_hypotheses,
)
from faultline.operators.memory import (
    active_hypotheses, hypothesis_evidence, hypothesis_state, number_hypotheses, upsert_facts,
)
from faultline.operators.response import (
    commands_by_category, decode_responses, suggested_commands,
)
from faultline.operators.sessions import (
    can_conclude, next_command, observations, observed_facts, pending_commands, session_rollup,
    stop_on_error, successful_results,
)
from faultline.plans.documents import document_texts
from faultline.plans.report import diagnosis_reports
from faultline.workload import render
from faultline.workload.registry import query
from faultline.workload.render import text

AS_OF = datetime(2024, 2, 1, 12, 0, 0)


def _responses(spark, folder) -> DataFrame:
    """A model answer per conversation turn: fenced in two ways, bare, sparse, or broken."""
    turns = render.table(spark, folder, "conversations")
    turns = bind(turns, "_full", F.to_json(F.struct(
        F.col("text").alias("problem_type"),
        F.array(F.col("role"), text("cause ", F.col("turn")), F.lit("第三"), F.lit("fourth"))
        .alias("possible_causes"),
        text("P", F.col("turn") % 3).alias("risk_level"),
        F.array(
            F.struct(F.lit("网络").alias("category"), F.lit("d").alias("description"),
                     text("ping ", F.col("conv_id")).alias("command")),
            F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string")
                     .alias("description"), F.lit("uptime").alias("command")),
            F.struct(F.lit("网络").alias("category"), F.lit("again").alias("description"),
                     F.lit("ss").alias("command")),
        ).alias("suggested_commands"),
        (F.col("turn") / 8).alias("confidence"),
    )))
    full = F.col("_full")
    kind = F.col("turn") % 5
    content = (
        F.when(kind == 0, text("Answer:\n```json\n", full, "\n```\nbye"))
        .when(kind == 1, text("```\n", full, "\n``` tail"))
        .when(kind == 2, full)
        .when(kind == 3, F.lit("```json\n{}\n```"))
        .otherwise(text("no json ", F.col("text")))
    )
    return bind(turns, "content", content).select(
        text(F.col("conv_id"), "-", F.col("turn")).alias("source"), "content"
    )


_FULL = "turn % 5 IN (0, 1, 2)"


@query("decoded_responses", "I2 I3", f"""
SELECT conv_id || '-' || turn AS source,
       CASE WHEN {_FULL} THEN text ELSE '未知' END AS problem_type,
       CASE WHEN {_FULL} THEN role || '|cause ' || turn || '|第三|fourth' ELSE '' END AS causes,
       CASE WHEN {_FULL} THEN 'P' || (turn % 3) ELSE 'P2' END AS risk_level,
       CASE WHEN {_FULL} THEN '网络/d/ping ' || conv_id || '|其他//uptime|网络/again/ss' ELSE '' END
         AS commands,
       CASE WHEN {_FULL} THEN turn / 8 ELSE 0.5 END::DOUBLE AS confidence
FROM conversations WHERE turn % 5 <> 4
""", with_events=False)
def decoded_responses(spark, folder) -> DataFrame:
    analyses = decode_responses(_responses(spark, folder)).analyses
    commands = F.transform(
        "suggested_commands",
        lambda c: F.concat_ws("/", c["category"], c["description"], c["command"]),
    )
    return analyses.select(
        "source", "problem_type", F.array_join("possible_causes", "|").alias("causes"),
        "risk_level", F.array_join(commands, "|").alias("commands"), "confidence",
    )


@query("failed_responses", "I2", """
SELECT conv_id || '-' || turn AS source, 'bad_json' AS reason FROM conversations WHERE turn % 5 = 4
""", with_events=False)
def failed_responses(spark, folder) -> DataFrame:
    return decode_responses(_responses(spark, folder)).failures.select("source", "reason")


@query("commands_by_category", "C8", f"""
SELECT conv_id || '-' || turn AS source, c.first AS category_first, c.category, c.idx AS command_idx,
       c.description, CASE c.idx WHEN 0 THEN 'ping ' || conv_id WHEN 1 THEN 'uptime' ELSE 'ss' END
         AS command
FROM conversations, (VALUES (0, 0, '网络', 'd'), (1, 1, '其他', ''), (0, 2, '网络', 'again'))
  c(first, idx, category, description)
WHERE {_FULL}
""", with_events=False)
def commands_by_category_(spark, folder) -> DataFrame:
    analyses = decode_responses(_responses(spark, folder)).analyses
    return commands_by_category(suggested_commands(analyses), "source")


@query("initial_facts", "I6", f"""
SELECT conv_id || '-' || turn AS source,
       '问题类型: ' || CASE WHEN {_FULL} THEN text ELSE '未知' END AS fact,
       'AI分析' AS fact_source, CASE WHEN {_FULL} THEN turn / 8 ELSE 0.5 END::DOUBLE AS confidence
FROM conversations WHERE turn % 5 <> 4
""", with_events=False)
def initial_facts_(spark, folder) -> DataFrame:
    analyses = decode_responses(_responses(spark, folder)).analyses.withColumnRenamed(
        "source", "session"
    )
    return initial_facts(analyses, "session").select(
        F.col("session").alias("source"), "fact", F.col("source").alias("fact_source"), "confidence"
    )


@query("initial_hypotheses", "I6", f"""
SELECT conv_id || '-' || turn AS source, h.id::BIGINT AS hypothesis_id,
       CASE h.id WHEN 0 THEN role WHEN 1 THEN 'cause ' || turn ELSE '第三' END AS hypothesis,
       round((turn / 8)::DOUBLE * (0.9 - h.id * 0.1), 9)::DOUBLE AS confidence
FROM conversations, (VALUES (0), (1), (2)) h(id) WHERE {_FULL}
""", with_events=False)
def initial_hypotheses_(spark, folder) -> DataFrame:
    analyses = decode_responses(_responses(spark, folder)).analyses
    return initial_hypotheses(analyses, "source").select(
        "source", "hypothesis_id", "hypothesis", F.round("confidence", 9).alias("confidence")
    )


_NOTES = (
    "CASE doc_id % 7 WHEN 0 THEN 'Request TIMED OUT' WHEN 1 THEN 'Connection refused by peer'"
    " WHEN 2 THEN 'lookup: No such host' WHEN 3 THEN 'rtt latency high' WHEN 4 THEN '0% packet loss'"
    " WHEN 5 THEN 'DNS timeout, time=3 ms' ELSE '' END"
)


def _outputs(spark, folder) -> DataFrame:
    """Documents with a phrase put in front, as command output."""
    notes = [
        "Request TIMED OUT", "Connection refused by peer", "lookup: No such host",
        "rtt latency high", "0% packet loss", "DNS timeout, time=3 ms", "",
    ]
    note = F.get(F.array(*[F.lit(n) for n in notes]), (F.col("doc_id") % 7).cast("int"))
    return render.table(spark, folder, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("seq"),
        text(note, "\n", F.col("text")).alias("output"),
    )


# kinds, their words in order, and what they establish
_FINDINGS_SQL = f"""
WITH found AS (
  SELECT source AS session_id, doc_id AS seq, k.kind, k.fact, k.confidence,
         (SELECT word FROM unnest(k.words) WITH ORDINALITY w(word, i)
          WHERE contains(lower({_NOTES} || chr(10) || text), lower(word)) ORDER BY i LIMIT 1)
           AS keyword
  FROM documents, (VALUES
    ('timeout', '存在超时问题', 0.8, ['timeout', 'timed out', '超时']),
    ('connection_refused', '连接被拒绝', 0.9, ['connection refused', '连接被拒绝']),
    ('dns_failure', '存在DNS问题', 0.8, ['no such host', 'dns', '解析失败', 'NXDOMAIN']),
    ('high_latency', NULL, NULL, ['time=', 'latency', '延迟']),
    ('packet_loss', NULL, NULL, ['packet loss', '丢失', '100% packet loss'])
  ) k(kind, fact, confidence, words)
)
"""


@query("findings", "I4", _FINDINGS_SQL + """
SELECT session_id, seq, kind, '检测到' || kind || ': ' || keyword AS finding
FROM found WHERE keyword IS NOT NULL
""", with_events=False)
def findings(spark, folder) -> DataFrame:
    return extract_findings(_outputs(spark, folder)).select("session_id", "seq", "kind", "finding")


@query("facts", "I5 M3", _FINDINGS_SQL + """
SELECT session_id, fact, '命令输出' AS source, CAST(max(confidence) AS DOUBLE) AS confidence,
       min(seq) AS position, max(seq) AS updated
FROM found WHERE keyword IS NOT NULL AND fact IS NOT NULL GROUP BY 1, 2
""", with_events=False)
def facts(spark, folder) -> DataFrame:
    return upsert_facts(findings_to_facts(extract_findings(_outputs(spark, folder))))


_RESULTS = """
WITH res AS (
  SELECT 's' || user_id AS session_id, event_id AS command_idx, 'probe ' || (event_id % 11) AS command,
         'h' || (user_id % 5) AS host, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS exit_code,
         CASE event_type WHEN 'signup' THEN 'reply time=12 ms' WHEN 'purchase' THEN 'Request timed out'
              WHEN 'view' THEN 'NXDOMAIN for host' WHEN 'click' THEN '0% packet loss' ELSE '' END ||
         CASE event_type WHEN 'error' THEN '' ELSE ' #' || event_id END AS stdout,
         CASE event_type WHEN 'error' THEN 'refused ' || (user_id % 9) ELSE '' END AS stderr,
         value AS duration, event_type
  FROM ev
)
"""


def _results(spark, folder) -> DataFrame:
    return render.results(render.events(spark, folder))


@query("observations", "I7", _RESULTS + """
SELECT session_id, command_idx, exit_code = 0 AS success,
       CASE exit_code WHEN 0 THEN stdout ELSE stderr END AS observation,
       '成功: ' || CASE exit_code WHEN 0 THEN 'True' ELSE 'False' END AS result_summary
FROM res
""")
def observations_(spark, folder) -> DataFrame:
    return observations(_results(spark, folder)).select(
        "session_id", "command_idx", "success", "observation", "result_summary"
    )


@query("observed_facts", "I7 I5 M3", _RESULTS + """
SELECT session_id, fact, count(*) AS n FROM (
  SELECT DISTINCT session_id,
         CASE event_type WHEN 'error' THEN '命令执行失败: ' || stderr WHEN 'purchase' THEN '存在超时问题'
              ELSE '存在DNS问题' END AS fact
  FROM res WHERE event_type IN ('error', 'purchase', 'view')
) GROUP BY 1, 2
""")
def observed_facts_(spark, folder) -> DataFrame:
    return upsert_facts(observed_facts(_results(spark, folder))).groupBy("session_id", "fact").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("successful_results", "I10", _RESULTS + """
SELECT session_id, command, exit_code, stdout, duration, host FROM res WHERE exit_code = 0
""")
def successful_results_(spark, folder) -> DataFrame:
    return successful_results(_results(spark, folder)).select(
        "session_id", "command", "exit_code", "stdout", "duration", "host"
    )


@query("session_rollup", "M8", _RESULTS + """
SELECT session_id, count(*) AS results, count(*) FILTER (exit_code = 0) AS successes,
       count(*) FILTER (exit_code <> 0) AS errors, round(sum(duration), 4) AS total_duration,
       CASE WHEN max(exit_code) = 1 THEN 'failed' ELSE 'completed' END AS status,
       max(command_idx % 7)::INT AS rounds_completed
FROM res GROUP BY 1
""")
def session_rollup_(spark, folder) -> DataFrame:
    entries = render.events(spark, folder).select(
        render.session().alias("session_id"), (F.col("event_id") % 7).alias("round")
    )
    return session_rollup(_results(spark, folder), entries=entries).withColumn(
        "total_duration", F.round("total_duration", 4)
    )


@query("stop_on_error", "C7", _RESULTS + """
SELECT session_id, command_idx, command, exit_code FROM (
  SELECT *, coalesce(max(exit_code) OVER (PARTITION BY session_id ORDER BY command_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed_before FROM res
) WHERE failed_before = 0
""")
def stop_on_error_(spark, folder) -> DataFrame:
    return stop_on_error(_results(spark, folder)).select(
        "session_id", "command_idx", "command", "exit_code"
    )


def _executed(spark, folder) -> DataFrame:
    return _results(spark, folder).filter("exit_code = 1").select(
        "session_id", F.col("command_idx").alias("seq"), "command"
    )


def _suggested(spark, folder) -> DataFrame:
    return _results(spark, folder).filter("exit_code = 0").select(
        "session_id", "command_idx", "command"
    )


_PENDING = _RESULTS.rstrip() + """,
pending AS (
  SELECT session_id, command_idx, command FROM res s
  WHERE exit_code = 0 AND NOT EXISTS (
    SELECT 1 FROM res e
    WHERE e.exit_code = 1 AND e.session_id = s.session_id AND e.command = s.command)
)
"""


@query("pending_commands", "I8", _PENDING + "SELECT * FROM pending")
def pending_commands_(spark, folder) -> DataFrame:
    return pending_commands(_suggested(spark, folder), _executed(spark, folder))


@query("next_command", "I8", _PENDING + """
SELECT session_id, min(command_idx) AS command_idx, arg_min(command, command_idx) AS command
FROM pending GROUP BY 1
""")
def next_command_(spark, folder) -> DataFrame:
    return next_command(pending_commands(_suggested(spark, folder), _executed(spark, folder)))


# Hypotheses: one per signup, updated by the other events of the same user.
_HYPOTHESES = """
WITH hyp AS (
  SELECT 's' || user_id AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS hypothesis_id,
         event_id AS seq, 'idea ' || event_id AS hypothesis, value / 500 AS confidence,
         sec AS created_at
  FROM ev WHERE event_type = 'signup'
),
upd AS (
  SELECT 's' || user_id AS session_id, event_id % 4 AS hypothesis_id, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' END AS status,
         CASE WHEN event_type IN ('purchase', 'click') THEN value / 100 END AS confidence,
         event_type
  FROM ev WHERE event_type <> 'signup'
),
state AS (
  SELECT hyp.session_id, hyp.hypothesis_id, hyp.hypothesis, hyp.created_at,
         coalesce((SELECT arg_max(u.status, u.seq) FROM upd u
                   WHERE u.session_id = hyp.session_id AND u.hypothesis_id = hyp.hypothesis_id
                     AND u.seq > hyp.seq AND u.status IS NOT NULL), 'active') AS status,
         coalesce((SELECT arg_max(u.confidence, u.seq) FROM upd u
                   WHERE u.session_id = hyp.session_id AND u.hypothesis_id = hyp.hypothesis_id
                     AND u.seq > hyp.seq AND u.confidence IS NOT NULL), hyp.confidence) AS confidence,
         1 + coalesce((SELECT count(*) FROM upd u
                   WHERE u.session_id = hyp.session_id AND u.hypothesis_id = hyp.hypothesis_id
                     AND u.seq > hyp.seq AND u.event_type = 'view'), 0) AS evidence_count
  FROM hyp
)
"""


def hypotheses_and_updates(spark, folder) -> tuple[DataFrame, DataFrame]:
    ev = render.events(spark, folder)
    created = ev.filter("event_type = 'signup'").select(
        render.session().alias("session_id"), F.col("event_id").alias("seq"),
        text("idea ", F.col("event_id")).alias("hypothesis"),
        F.array(F.lit("seen")).alias("evidence"), (F.col("value") / 500).alias("confidence"),
        F.col("sec").alias("created_at"),
    )
    kind = F.col("event_type")
    updates = ev.filter("event_type <> 'signup'").select(
        render.session().alias("session_id"), (F.col("event_id") % 4).alias("hypothesis_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "confirmed").when(kind == "error", "rejected")
        .when(kind == "view", "").alias("status"),
        F.when(kind.isin("purchase", "click"), F.col("value") / 100).alias("confidence"),
        F.when(kind == "view", F.array(text("view ", F.col("event_id")))).alias("new_evidence"),
    )
    return number_hypotheses(created), updates


@query("hypothesis_state", "M4", _HYPOTHESES + """
SELECT session_id, hypothesis_id, hypothesis, status, confidence, evidence_count, created_at FROM state
""")
def hypothesis_state_(spark, folder) -> DataFrame:
    state = hypothesis_state(*hypotheses_and_updates(spark, folder))
    return state.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("active_hypotheses", "M4", _HYPOTHESES + """
SELECT session_id, hypothesis_id, hypothesis FROM state WHERE status = 'active'
""")
def active_hypotheses_(spark, folder) -> DataFrame:
    state = hypothesis_state(*hypotheses_and_updates(spark, folder))
    return active_hypotheses(state).select("session_id", "hypothesis_id", "hypothesis")


@query("hypothesis_evidence", "M4", _HYPOTHESES + """
SELECT session_id, hypothesis_id, -1 AS seq, 'seen' AS evidence FROM hyp
UNION ALL
SELECT u.session_id, u.hypothesis_id, u.seq, 'view ' || u.seq FROM upd u
JOIN hyp ON hyp.session_id = u.session_id AND hyp.hypothesis_id = u.hypothesis_id
WHERE u.event_type = 'view' AND u.seq > hyp.seq
""")
def hypothesis_evidence_(spark, folder) -> DataFrame:
    return hypothesis_evidence(*hypotheses_and_updates(spark, folder)).select(
        "session_id", "hypothesis_id", "seq", "evidence"
    )


@query("can_conclude", "I9", _HYPOTHESES.rstrip() + """,
ran AS (SELECT 's' || user_id AS session_id, count(*) AS n FROM ev WHERE event_type = 'error'
        GROUP BY 1),
sure AS (SELECT session_id, bool_or(status = 'confirmed' AND confidence > 0.8) AS s FROM state
         GROUP BY 1)
SELECT coalesce(ran.session_id, sure.session_id) AS session_id,
       coalesce(s, false) OR coalesce(n, 0) >= 3 AS can_conclude
FROM ran FULL JOIN sure ON ran.session_id = sure.session_id
""")
def can_conclude_(spark, folder) -> DataFrame:
    state = hypothesis_state(*hypotheses_and_updates(spark, folder))
    return can_conclude(state, _executed(spark, folder))


@query("diagnosis_report", "R5", _HYPOTHESES.rstrip() + """,
who AS (SELECT DISTINCT user_id, 's' || user_id AS session_id FROM ev),
fact AS (
  SELECT 's' || user_id AS session_id, '命令执行失败: refused ' || (user_id % 9) AS fact
  FROM ev WHERE event_type = 'error' GROUP BY user_id
)
SELECT session_id, 0::BIGINT AS part, '# 网络诊断报告' || chr(10) || chr(10) ||
  '**诊断时间**: 2024-02-01 12:00:00' || chr(10) || '**执行轮次**: ' || (user_id % 5) || chr(10) ||
  chr(10) ||
  CASE WHEN user_id % 2 = 0 THEN '## 问题概述' || chr(10) || chr(10) || '- **问题类型**: 高延迟' ||
    chr(10) || '- **风险等级**: P1' || chr(10) || '- **置信度**: 85%' || chr(10) || chr(10)
    ELSE '' END ||
  coalesce((SELECT '## 发现的事实' || chr(10) || chr(10) || '- ' || fact || ' (置信度: 100%)' ||
    chr(10) || chr(10) FROM fact WHERE fact.session_id = who.session_id), '') ||
  coalesce((SELECT '## 假设验证' || chr(10) || chr(10) || string_agg('- ' ||
    CASE status WHEN 'confirmed' THEN '✓ 已确认' WHEN 'rejected' THEN '✗ 已排除' ELSE '? 待验证' END ||
    ': ' || hypothesis || ' (置信度: ' || printf('%.0f', confidence * 100) || '%)', chr(10)
    ORDER BY hypothesis_id) || chr(10) || chr(10)
    FROM state WHERE state.session_id = who.session_id), '') ||
  coalesce((SELECT '## 执行的诊断命令' || chr(10) || chr(10) || string_agg('- `probe ' ||
    (event_id % 11) || '`', chr(10) ORDER BY event_id) || chr(10) || chr(10) FROM ev
    WHERE ev.user_id = who.user_id AND event_type = 'error'), '') ||
  CASE WHEN user_id % 2 = 0 THEN '## 建议的排查步骤' || chr(10) || chr(10) || '1. 路由' || chr(10) ||
    '2. 网卡' || chr(10) || chr(10) ELSE '' END AS text
FROM who
""")
def diagnosis_report(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    state = hypothesis_state(*hypotheses_and_updates(spark, folder))
    failures = _results(spark, folder).filter("exit_code = 1")
    known = upsert_facts(observed_facts(failures))
    even = F.col("user_id") % 2 == 0
    sessions = ev.select("user_id").distinct().select(
        render.session().alias("session_id"), (F.col("user_id") % 5).alias("rounds"),
        F.when(even, "高延迟").alias("problem_type"), F.lit("P1").alias("risk_level"),
        F.lit(0.85).alias("confidence"),
        F.array(F.lit("路由"), F.lit("网卡")).alias("possible_causes"),
    )
    lines = diagnosis_reports(sessions, known, state, _executed(spark, folder), moment(AS_OF))
    return document_texts(lines, "session_id")
