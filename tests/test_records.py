"""Audit, memory, sessions, responses and the documents made of them."""

import csv
import json
import shutil
from datetime import datetime, timedelta
from types import SimpleNamespace
from urllib.parse import unquote, unquote_plus

import pytest
from pyspark.sql import functions as F

from faultline.operators.audit import (
    agent_action_events, analyze_events, audit_entry, audit_statistics, command_events, query_audit,
    recent_audit, ssh_connect_events,
)
from faultline.operators.findings import (
    extract_findings, findings_to_facts, initial_facts, initial_hypotheses,
)
from faultline.operators.memory import (
    active_hypotheses, entries_of_round, hypothesis_evidence, hypothesis_state, memory_summary,
    number_hypotheses, recent_entries, upsert_facts,
)
from faultline.operators.memory_json import ORDER as JSON_ORDER
from faultline.operators.memory_json import memory_documents, memory_tables
from faultline.operators.ordered import numbered
from faultline.operators.response import decode_responses, suggested_commands
from faultline.operators.sessions import (
    can_conclude, next_command, observations, observed_facts, pending_commands, session_rollup,
    stop_on_error, successful_results,
)
from faultline.plans.documents import ORDER, Section, assemble, document_texts, write_documents
from faultline.plans.report import diagnosis_reports
from faultline.schema import AUDIT, MEMORY, RESULTS
from faultline.session import shared_folder
from faultline.sources.audit_store import (
    append_audit, export_audit, index_audit, lookup_audit, newest_audit, read_audit,
)
from faultline.sources.fact_store import FactStore
from faultline.sources.records import from_records, to_records
from faultline.sources.sinks import write_reports, write_session_results
from faultline.workload import all_queries

T0 = datetime(2026, 2, 24, 10)


@pytest.fixture
def audit(spark):
    def row(i, action, result, host, **more):
        base = dict.fromkeys(AUDIT.fieldNames()) | {
            "id": str(i), "timestamp": T0 + timedelta(hours=i), "action": action, "result": result,
            "host": host, "duration_ms": i, "details": {},
        }
        return tuple((base | more).values())

    return spark.createDataFrame(
        [
            row(1, "action_a", "success", "host1", command="x" * 50),
            row(2, "action_b", "failure", "host1", details={"log_file": "/v"}),
            row(3, "action_a", "success", "host2", timestamp=T0 + timedelta(hours=2)),
            row(4, "action_a", "success", "", error_message='say "hi",\nbye'),
        ],
        AUDIT,
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_audit_queries(audit):
    assert ids(query_audit(audit)) == ["4", "2", "3", "1"]
    assert ids(query_audit(audit, limit=2)) == ["4", "2"]
    assert ids(query_audit(audit, action="action_a", result="success", host="host1")) == ["1"]
    assert ids(query_audit(audit, T0 + timedelta(hours=1), T0 + timedelta(hours=2))) == ["2", "3", "1"]
    assert ids(audit_entry(audit, "3")) == ["3"] and ids(audit_entry(audit, "9")) == []
    assert "TakeOrderedAndProject" in query_audit(audit)._jdf.queryExecution().executedPlan().toString()
    recent = recent_audit(audit, T0 + timedelta(hours=26)).collect()
    assert [(r["time"], r["host"], r["detail"]) for r in recent] == [
        ("02-24 14:00:00", "-", "-"), ("02-24 12:00:00", "host1", "/v"),
        ("02-24 12:00:00", "host2", "-"),
    ]


def test_audit_statistics(audit):
    found = {(r["dimension"], r["value"]): r["count"] for r in audit_statistics(audit).collect()}
    assert found == {
        ("total", None): 4, ("action", "action_a"): 3, ("action", "action_b"): 1,
        ("result", "success"): 3, ("result", "failure"): 1, ("host", "host1"): 2, ("host", "host2"): 1,
    }


def test_merged_facts_equal_one_fold(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"), "source string, confidence double", buckets=8)
    kinds = "session_id string, seq bigint, fact string, source string, confidence double"
    rows = [(f"s{i % 13}", i, f"f{i * i % 5}", None if i % 7 == 0 else f"e{i}", i / 400) for i in range(400)]
    rows += [(None, 500, "f1", "x", None), ("s1", 501, None, "y", 0.5)]

    def frame(part):
        return spark.createDataFrame(part, kinds)

    def state(table):
        return sorted(map(tuple, table.collect()), key=repr)

    assert store.facts().count() == 0 and store.merge(frame([])) == []
    for part in (rows[200:], rows[:200], rows[200:300]):
        store.merge(frame(part))
    want = state(upsert_facts(frame(rows)))
    assert state(store.facts()) == want

    # A batch of one session rewrites its bucket alone, and a search for the session reads no other.
    files = set(store.facts().inputFiles())
    (touched,) = store.merge(frame([("s3", 900, "new", "z", 1.0)]))
    fresh = set(store.facts().inputFiles()) - files
    assert fresh and all(f"bucket={touched}/" in f for f in fresh)
    assert all(f"bucket={touched}/" in f for f in files - set(store.facts().inputFiles()))
    assert set(store.facts("s3").inputFiles()) == fresh
    assert state(store.facts("s3")) == state(upsert_facts(frame([r for r in rows if r[0] == "s3"] + [("s3", 900, "new", "z", 1.0)])))

    # A version that was lost half way does not count, and the next merge passes it.
    before = state(store.facts())
    lost = tmp_path / "facts" / "of=8" / "version=9"
    shutil.copytree(next((tmp_path / "facts" / "of=8").glob("version=1")), lost)
    (lost / "_SUCCESS").unlink()
    assert state(store.facts()) == before
    store.merge(frame([("s4", 901, "new", "z", 1.0)]))
    assert len(state(store.facts())) == len(before) + 1
    now = state(store.facts())
    assert store.tidy() > 0 and store.tidy() == 0 and state(store.facts()) == now
    with pytest.raises(ValueError, match="8 buckets"):
        FactStore(spark, str(tmp_path / "facts"), "source string", buckets=4).facts()


def test_audit_store_and_export(spark, audit, tmp_path):
    folder = str(tmp_path / "store")
    append_audit(audit, folder)
    append_audit(audit.limit(1), folder)
    back = read_audit(spark, folder)
    assert back.count() == 5
    first = [r for r in back.collect() if r["id"] == "4"][0]
    assert (first["timestamp"], first["error_message"]) == (T0 + timedelta(hours=4), 'say "hi",\nbye')
    raw = "".join(f.read_text() for f in (tmp_path / "store").glob("date=2026-02-24/*/*.json"))
    assert '"timestamp":"2026-02-24T1' in raw and '"command":null' in raw

    export_audit(audit, str(tmp_path / "csv"), "csv")
    (path,) = (tmp_path / "csv").glob("*.csv")
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    assert [r["id"] for r in rows] == ["4", "2", "3", "1"]
    assert rows[0]["error_message"] == 'say "hi",\nbye'
    assert json.loads(rows[1]["details"]) == {"log_file": "/v"} and rows[0]["details"] == "{}"
    export_audit(audit, str(tmp_path / "json"), "json", limit=2)
    text = next((tmp_path / "json").glob("*.json")).read_text().splitlines()
    assert [json.loads(line)["timestamp"] for line in text] == [
        "2026-02-24T14:00:00", "2026-02-24T12:00:00"
    ]
    with pytest.raises(ValueError):
        export_audit(audit, str(tmp_path / "xml"), "xml")


def _many(spark, n=4000):
    """Audit entries of 40 days whose ids have no order."""
    ids = F.md5(F.col("id").cast("string"))
    return audit_rows(spark.range(n).select(
        ids.alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * (40 * 86_400 // n)).alias("timestamp"),
        F.when(F.col("id") % 400 == 0, "ssh_connect").otherwise("log_analyze").alias("action"),
    ))


def audit_rows(df):
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT.fields
    ])


def test_an_appended_batch_counts_once(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), _many(spark)
    append_audit(rows.limit(1000), folder, "1")
    append_audit(rows, folder, "2")
    append_audit(rows, folder, "2")
    assert read_audit(spark, folder).count() == 5000


def _scanned(found, metric):
    """A figure of the scan at the bottom of the plan, which must have run."""
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply(metric).value()


def test_newest_entries_come_from_the_newest_folders(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), _many(spark)
    undated = audit_rows(spark.createDataFrame([("x", "log_analyze")], "id string, action string"))
    append_audit(rows.unionByName(undated), folder)
    for conditions, limit, days in (({}, 50, 1), ({}, 150, 3), ({"action": "ssh_connect"}, 2, 15), ({}, 10_000, 42)):
        found = newest_audit(spark, folder, limit, **conditions)
        found.collect()
        assert _scanned(found, "numPartitions") <= days, (conditions, limit)
        want = query_audit(rows.unionByName(undated), limit=limit, **conditions)
        assert [r["id"] for r in query_audit(found, limit=limit).collect()] == [r["id"] for r in want.collect()]


def test_lookup_by_id_skips_row_groups(spark, tmp_path):
    def read(folder, entry_id):
        """Rows found, and rows that the scan gives."""
        found = lookup_audit(spark, folder, entry_id)
        return len(found.collect()), _scanned(found, "numOutputRows")

    rows = _many(spark)
    there = rows.orderBy("timestamp").first()["id"]
    for bloom in (True, False):
        folder = str(tmp_path / f"index-{bloom}")
        index_audit(rows, folder, "1", bloom)
        found, scanned = read(folder, there)
        assert found == 1 and scanned < 400
        # Ids between others of their folders: only a filter can tell that they are not there.
        scans = [read(folder, f"{i:032x}") for i in range(1 << 125, (1 << 125) * 7, 1 << 125)]
        assert all(n == 0 for n, _ in scans)
        assert (sum(n for _, n in scans) == 0) == bloom


def test_audit_events(spark):
    one = spark.range(1)
    ran = command_events(one.select(
        F.lit("h").alias("host"), F.lit("success").alias("result"),
        F.repeat(F.lit("y"), 600).alias("stdout_preview"), F.lit("").alias("stderr_preview"),
    )).collect()[0]
    assert ran["action"] == "command_execute" and ran["details"] == {
        "exit_code": "0", "stdout_preview": "y" * 500
    }
    assert ran["id"] and ran["timestamp"] and ran["duration_ms"] == 0
    ssh = ssh_connect_events(one.select(F.lit("u").alias("username"))).collect()[0]
    assert (ssh["user"], ssh["details"]) == ("u", {"port": "22"})
    done = analyze_events(one.select(F.lit("/l").alias("log_file"))).collect()[0]
    assert done["details"] == {"log_file": "/l"}
    step = agent_action_events(one.select(
        F.lit(2).alias("round"), F.lit("run").alias("action_type"),
        F.create_map(F.lit("round"), F.lit("9")).alias("extra"),
    )).collect()[0]
    assert step["details"] == {"action_type": "run", "round": "9"}


@pytest.fixture
def results(spark):
    rows = [
        ("s", 0, 0, "a", "h", 0, "reply time=1 ms", "", 1.5, T0), ("s", 0, 1, "a", "k", 1, "", "boom", 0.5, T0),
        ("s", 1, 0, "b", "h", 0, "DNS timeout", "", 1.0, T0), ("t", 0, 0, "a", "h", 0, "x" * 1200, "", 2.0, T0),
        ("t", 1, 0, "b", "h", 2, "", "", 2.0, T0),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_sessions(results):
    kept = stop_on_error(results).orderBy("session_id", "command_idx", "host_idx").collect()
    assert [(r["session_id"], r["command_idx"], r["host_idx"]) for r in kept] == [
        ("s", 0, 0), ("s", 0, 1), ("t", 0, 0), ("t", 1, 0)
    ]
    rollup = {r["session_id"]: tuple(r)[1:] for r in session_rollup(results).collect()}
    assert rollup == {"s": (3, 2, 1, 3.0, "failed"), "t": (2, 1, 1, 4.0, "failed")}
    assert session_rollup(results, stops_on_error=False).filter("status = 'failed'").count() == 0
    assert successful_results(results).count() == 3
    seen = {(r["session_id"], r["command_idx"], r["host_idx"]): r for r in observations(results).collect()}
    assert len(seen["t", 0, 0]["output"]) == 1000 and len(seen["t", 0, 0]["observation"]) == 500
    assert (seen["s", 0, 1]["observation"], seen["s", 0, 1]["result_summary"]) == ("boom", "成功: False")
    assert seen["t", 1, 0]["error"] is None and seen["t", 1, 0]["observation"] == ""
    facts = [(r["session_id"], r["fact"], r["confidence"]) for r in
             observed_facts(results).orderBy("session_id", "seq").collect()]
    assert facts == [("s", "命令执行失败: boom", 1.0), ("s", "存在超时问题", 0.8), ("s", "存在DNS问题", 0.8)]


def test_pending_and_conclusion(spark):
    suggested = spark.createDataFrame(
        [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("t", 0, "a")],
        "session_id string, command_idx bigint, command string",
    )
    ran = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "z"), ("t", 1, "b")],
                                "session_id string, seq bigint, command string")
    pending = pending_commands(suggested, ran)
    assert sorted(tuple(r) for r in pending.collect()) == [("s", 1, "b"), ("s", 2, "c"), ("t", 0, "a")]
    assert sorted(tuple(r) for r in next_command(pending).collect()) == [("s", 1, "b"), ("t", 0, "a")]
    state = spark.createDataFrame(
        [("t", "confirmed", 0.8), ("u", "confirmed", 0.81), ("v", "active", 0.9)],
        "session_id string, status string, confidence double",
    )
    assert dict(tuple(r) for r in can_conclude(state, ran).collect()) == {
        "s": True, "t": False, "u": True, "v": False
    }


def test_findings(spark):
    texts = ["0% PACKET LOSS, time=3", "NXDOMAIN", "Timed out: connection refused", "fine", "请求超时"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output string")
    found = extract_findings(df)
    assert [(r["i"], r["finding"]) for r in found.orderBy("i", "kind").collect()] == [
        (0, "检测到high_latency: time="), (0, "检测到packet_loss: packet loss"),
        (1, "检测到dns_failure: NXDOMAIN"), (2, "检测到connection_refused: connection refused"),
        (2, "检测到timeout: timed out"), (4, "检测到timeout: 超时"),
    ]
    facts = findings_to_facts(found).orderBy("i", "fact").collect()
    assert [(r["i"], r["fact"], r["confidence"]) for r in facts] == [
        (1, "存在DNS问题", 0.8), (2, "存在超时问题", 0.8), (2, "连接被拒绝", 0.9), (4, "存在超时问题", 0.8),
    ]


def test_responses(spark):
    full = {
        "problem_type": "连接超时", "possible_causes": ["a", "b", "c", "d"], "risk_level": None,
        "suggested_commands": [{"command": "ss"}, {"category": "端口", "description": "d", "command": "x"}],
        "confidence": 0.8,
    }
    body = json.dumps(full, ensure_ascii=False)
    cases = {
        "json": f"text\n```json\n{body}\n```\nend ```x```", "plain": f"```\n{body}\n```", "bare": body,
        "empty": "{}", "text": "garbage", "broken": "```json\n{\"a\": 1\n```", "list": "[1]", "tail": "{} x",
    }
    df = spark.createDataFrame(list(cases.items()), "session_id string, content string")
    analyses, failures = decode_responses(df)
    rows = {r["session_id"]: r for r in analyses.collect()}
    assert set(rows) == {"json", "plain", "bare", "empty"}
    assert {r["session_id"] for r in failures.collect()} == {"text", "broken", "list", "tail"}
    for name in ("json", "plain", "bare"):
        r = rows[name]
        assert r["risk_level"] is None and r["confidence"] == 0.8
        assert [tuple(c) for c in r["suggested_commands"]] == [("其他", "", "ss"), ("端口", "d", "x")]
    e = rows["empty"]
    assert (e["problem_type"], e["possible_causes"], e["risk_level"], e["confidence"]) == ("未知", [], "P2", 0.5)
    assert suggested_commands(analyses, "session_id").count() == 6
    assert initial_facts(analyses).filter("session_id = 'bare'").first()["fact"] == "问题类型: 连接超时"
    ideas = initial_hypotheses(analyses).filter("session_id = 'bare'").orderBy("hypothesis_id").collect()
    assert [(h["hypothesis"], h["confidence"]) for h in ideas] == [
        (c, 0.8 * (0.9 - i * 0.1)) for i, c in enumerate("abc")
    ]


def test_memory(spark):
    facts = upsert_facts(spark.createDataFrame(
        [("s", 1, "f", "a", 0.5), ("s", 2, "g", "b", 1.0), ("s", 3, "f", "c", 0.9)],
        "session_id string, seq bigint, fact string, source string, confidence double",
    ))
    assert sorted((r["fact"], r["source"], r["confidence"], r["position"]) for r in facts.collect()) == [
        ("f", "c", 0.9, 1), ("g", "b", 1.0, 2)
    ]
    created = number_hypotheses(spark.createDataFrame(
        [("s", 30, "later", ["e"], 0.4), ("s", 10, "first", [], 0.6)],
        "session_id string, seq bigint, hypothesis string, evidence array<string>, confidence double",
    ))
    updates = spark.createDataFrame(
        [("s", 0, 40, "confirmed", None, ["x", "y"]), ("s", 0, 50, "", 0.95, None),
         ("s", 0, 45, "rejected", None, None), ("s", 7, 60, "confirmed", 1.0, ["lost"])],
        "session_id string, hypothesis_id bigint, seq bigint, status string, confidence double,"
        " new_evidence array<string>",
    )
    state = hypothesis_state(created, updates)
    assert sorted(tuple(r)[1:] for r in state.collect()) == [
        (0, "first", "rejected", 0.95, 2), (1, "later", "active", 0.4, 1)
    ]
    assert [r["hypothesis"] for r in active_hypotheses(state).collect()] == ["later"]
    evidence = hypothesis_evidence(created, updates).orderBy("hypothesis_id", "seq", "position")
    assert [r["evidence"] for r in evidence.collect()] == ["x", "y", "e"]

    decisions = spark.createDataFrame(
        [("s", 1, "go", "why", ["stay"])],
        "session_id string, seq bigint, decision string, reasoning string, alternatives array<string>",
    )
    entries = spark.createDataFrame(
        [("s", i, T0, i % 2, "execute", f"step {i}", "o", "r", {"k": "v"}) for i in range(1, 13)], MEMORY
    )
    assert [r["id"] for r in recent_entries(entries).orderBy("id").collect()] == [8, 9, 10, 11, 12]
    assert entries_of_round(entries, 1).count() == 6
    text = texts_of(memory_summary(facts, state, decisions, entries), "session_id")["s"]
    assert text == "\n".join(
        ["# 诊断记忆摘要", "", "## 发现的事实", "- f (来源: c, 置信度: 90%)", "- g (来源: b, 置信度: 100%)", "",
         "## 假设", "- [✗] first (置信度: 95%)", "- [?] later (置信度: 40%)", "", "## 做出的决策", "- go", "",
         "## 最近操作"] + [f"- Round {i % 2}: [execute] step {i}" for i in range(3, 13)] + [""]
    )


def test_memory_documents(spark):
    """All tables come back from the documents, which Python reads as JSON."""
    entries = spark.createDataFrame(
        [("s", i, T0, i, "execute", 'say "hi"\n', "o", "r", {"k": "v"}) for i in (1, 2)], MEMORY
    )
    context = spark.createDataFrame(
        [("s", 0, "a", '{"x":[1,2]}'), ("s", 1, 'b"', "3"), ("t", 0, "c", '"3"')],
        "session_id string, position bigint, key string, value string",
    )
    facts = spark.createDataFrame(
        [("s", "z", "cmd", 0.5, T0, 1, 4), ("s", "a", "cmd", None, T0, 2, 2)],
        "session_id string, fact string, source string, confidence double, timestamp timestamp, position bigint, updated bigint",
    )
    created = number_hypotheses(spark.createDataFrame(
        [("s", 3, "h", ["e1", "e,2"], 0.5, T0), ("s", 5, "bare", [], 0.25, T0)],
        "session_id string, seq bigint, hypothesis string, evidence array<string>, confidence double, created_at timestamp",
    ))
    updates = spark.createDataFrame(
        [("s", 0, 9, None, None, ["e3", "e4"]), ("s", 0, 7, "confirmed", 0.75, ["e5"])],
        "session_id string, hypothesis_id bigint, seq bigint, status string, confidence double, new_evidence array<string>",
    )
    decisions = spark.createDataFrame(
        [("u", 4, "go", "why", ["stay"], T0)],
        "session_id string, seq bigint, decision string, reasoning string, alternatives array<string>, timestamp timestamp",
    )
    state, evidence = hypothesis_state(created, updates), hypothesis_evidence(created, updates)
    rows = memory_documents(entries, context, facts, state, evidence, decisions)
    texts = texts_of(rows, "session_id", JSON_ORDER)
    documents = {k: json.loads(v) for k, v in texts.items()}
    assert set(documents) == {"s", "t", "u"}
    assert documents["t"] == {"entries": [], "context": {"c": "3"}, "facts": {}, "hypotheses": [], "decisions": []}
    assert list(documents["s"]["facts"]) == ["z", "a"] and documents["s"]["context"] == {"a": {"x": [1, 2]}, 'b"': 3}
    assert [h["evidence"] for h in documents["s"]["hypotheses"]] == [["e1", "e,2", "e5", "e3", "e4"], []]
    assert documents["s"]["hypotheses"][0]["created_at"] == "2026-02-24T10:00:00"
    back = memory_tables(spark.createDataFrame(list(texts.items()), "session_id string, json string"))

    def same(got, want):
        return sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))

    assert same(back["entries"], entries) and same(back["context"], context)
    assert same(back["hypotheses"], state.withColumn("evidence_count", F.col("evidence_count").cast("bigint")))
    assert same(back["decisions"].drop("seq"), decisions.drop("seq"))
    assert same(back["facts"].drop("position", "updated"), facts.drop("position", "updated"))
    assert [r["evidence"] for r in back["evidence"].orderBy("position").collect()] == ["e1", "e,2", "e5", "e3", "e4"]
    assert texts_of(memory_documents(**back), "session_id", JSON_ORDER) == texts


def test_numbering_across_chunks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"))
    rows = numbered(df, ["k"], "o", "n", bits=4).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r["o"]):
        groups.setdefault(r["k"], []).append(r["n"])
    assert all(found == list(range(1, len(found) + 1)) for found in groups.values())


def texts_of(rows, key, order=ORDER):
    """Each key's document, from its lines."""
    texts = {}
    for r in rows.orderBy(key, *order).collect():
        texts.setdefault(r[key], []).append(r["line"])
    return {k: "\n".join(v) for k, v in texts.items()}


@pytest.mark.parametrize("size", [1, 4200, 10_000])
def test_documents_of_any_length_have_one_shape(spark, tmp_path, size):
    lines = spark.range(size + 2).select(
        F.when(F.col("id") < size, "a long/key").otherwise("short").alias("k"), F.col("id").alias("pos"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"),
    )
    rows = assemble("k", [Section("T", lines), Section("U", lines, gap=True)], ["top", ""])
    assert rows.columns == ["k", "section", "place", "pos", "line"]
    texts = texts_of(rows, "k")
    for key, numbers in {"a long/key": range(size), "short": range(size, size + 2)}.items():
        body = [f"line {i}" for i in numbers]
        assert texts[key] == "\n".join(["top", "", "T", *body, "", "U", "", *body, ""])
    # Small tasks are not put together, so that a long document has several files.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_documents(rows, "k", str(tmp_path / "out"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folders = {unquote_plus(unquote(f.name.split("=")[1])): f for f in (tmp_path / "out").iterdir() if f.is_dir()}
    for key, text in texts.items():
        files = sorted(folders[key].glob("part-*"))
        assert "".join(f.read_text() for f in files) == text + "\n"
        assert size < 10_000 or key == "short" or len(files) > 1


@pytest.mark.parametrize("size", [1, 4200])
def test_documents_as_texts(spark, size):
    """A short document is one text; the parts of a long one, joined in their order, are the document."""
    lines = spark.range(size + 2).select(
        F.when(F.col("id") < size, "long").alias("k"), F.col("id").alias("pos"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"),
    )
    rows = assemble("k", [Section("T", lines), Section("U", lines, gap=True)], opening=["top", ""])
    texts = texts_of(rows, "k")
    parts = {}
    for r in document_texts(rows, "k").orderBy("k", "part").collect():
        parts.setdefault(r["k"], []).append((r["part"], r["text"]))
    assert {k: "".join(t for _, t in v) for k, v in parts.items()} == {k: v + "\n" for k, v in texts.items()}
    assert [p for p, _ in parts[None]] == [0]
    assert (len(parts["long"]) > 1) == (size > 4096) and all(t.count("\n") <= 4096 for _, t in parts["long"])


def test_sessions_end_in_one_text_each(spark, tmp_path):
    """The registered queries write whole documents, not their lines."""
    kinds = ["signup", "click", "view", "error", "purchase"]
    spark.createDataFrame(
        [(i, i % 2, kinds[i // 2 % 5], float(i), T0 + timedelta(minutes=i)) for i in range(20)],
        "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz",
    ).write.parquet(str(tmp_path / "events.parquet"))
    found = {
        name: {r["session_id"]: r["text"] for r in all_queries()[name].run(spark, str(tmp_path)).collect() if r["part"] == 0}
        for name in ("memory_summary", "diagnosis_report")
    }
    assert found["memory_summary"].keys() == found["diagnosis_report"].keys() == {"s0", "s1"}
    summary, report = found["memory_summary"]["s1"], found["diagnosis_report"]["s1"]
    assert summary.startswith("# 诊断记忆摘要\n\n## 发现的事实\n- saw signup (来源: e11,")
    assert summary.endswith("## 最近操作\n" + "".join(
        f"- Round 1: [{kinds[i // 2 % 5]}] act {i}\n" for i in range(1, 20, 2)) + "\n")
    assert report.startswith("# 网络诊断报告\n\n**诊断时间**: 2024-02-01 12:00:00\n**执行轮次**: 1\n\n## 发现的事实\n\n")
    assert report.endswith("## 执行的诊断命令\n\n- `probe 7`\n- `probe 6`\n\n")


def test_round_trip_builds_documents_once(spark, tmp_path):
    """The tables are read from the written documents; no event is rendered again for each of them."""
    spark.createDataFrame(
        [(i, i % 2, "signup", float(i), T0) for i in range(4)],
        "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz",
    ).write.parquet(str(tmp_path / "events.parquet"))
    back = all_queries()["memory_round_trip"].run(spark, str(tmp_path))
    assert back.inputFiles() and not any("events.parquet" in file for file in back.inputFiles())
    assert back.filter("section = 'entries'").count() == 4


def test_diagnosis_report(spark):
    sessions = spark.createDataFrame(
        [("s", 3, "高延迟", "P1", 0.85, ["a", "b"]), ("t", 1, None, None, None, None),
         ("u", 2, "x", "P2", 0.5, [])],
        "session_id string, rounds int, problem_type string, risk_level string, confidence double,"
        " possible_causes array<string>",
    )
    facts = spark.createDataFrame([("s", "f", 1.0, 5)],
                                  "session_id string, fact string, confidence double, position bigint")
    ideas = spark.createDataFrame(
        [("s", 0, "h", "confirmed", 0.9), ("s", 1, "i", "odd", 0.1)],
        "session_id string, hypothesis_id bigint, hypothesis string, status string, confidence double",
    )
    ran = spark.createDataFrame([("s", 1, "ping")], "session_id string, seq bigint, command string")
    texts = texts_of(diagnosis_reports(sessions, facts, ideas, ran, F.lit(T0)), "session_id")
    head = ["# 网络诊断报告", "", "**诊断时间**: 2026-02-24 10:00:00"]
    assert texts["t"] == "\n".join(head + ["**执行轮次**: 1", ""])
    assert texts["u"] == "\n".join(
        head + ["**执行轮次**: 2", "", "## 问题概述", "", "- **问题类型**: x", "- **风险等级**: P2",
                "- **置信度**: 50%", "", "## 建议的排查步骤", "", ""]
    )
    assert texts["s"].endswith("\n".join(
        ["- **置信度**: 85%", "", "## 发现的事实", "", "- f (置信度: 100%)", "", "## 假设验证", "",
         "- ✓ 已确认: h (置信度: 90%)", "- odd: i (置信度: 10%)", "", "## 执行的诊断命令", "", "- `ping`", "",
         "## 建议的排查步骤", "", "1. a", "2. b", ""]
    ))


def test_records_and_sinks(spark, results, tmp_path):
    back = from_records(to_records(results), RESULTS)
    assert back.exceptAll(results).count() == 0 and back.count() == 5
    record = json.loads(to_records(results, "session_id").filter("session_id = 't'").first()["record"])
    assert record["ts"] == "2026-02-24T10:00:00"
    write_session_results(results, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).filter("success").count() == 3
    reports = spark.createDataFrame([("dir/a.log", "x\ny")], "source string, report string")
    write_reports(reports, str(tmp_path / "t"), fmt="text")
    assert next((tmp_path / "t").glob("source=*/part*")).read_text() == "x\ny\n"
    write_reports(reports, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == reports.collect()


def test_shared_folder():
    def session(named):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf))

    assert shared_folder(session("/shared"), "/fallback") == "/shared"
    assert shared_folder(session(None), "/fallback") == "/fallback"
    with pytest.raises(ValueError):
        shared_folder(session(None))
