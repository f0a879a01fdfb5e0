"""Scans, detection, multi-line events and the path from files to results."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.operators.custom import CustomFormat, ParserConfig
from faultline.operators.detect import detect_formats, report_format_label
from faultline.operators.lineformat import parse_as
from faultline.operators.multiline import event_heads, event_lines, multiline_lines
from faultline.operators.parse import parse_logs
from faultline.operators.templates import TEMPLATES
from faultline.plans.analysis import analyze_files, file_sizes
from faultline.sources.lines import read_files, read_heads, read_lines, replaced_bytes

WEB = [
    f'10.0.0.{i} - - [15/Feb/2026:10:00:0{i} +0800] "GET /{i % 2} HTTP/1.1" {s} 9 "-" "x"'
    for i, s in enumerate((200, 500, 502, 200, 500))
]
BALANCER = [
    f"Feb 15 10:00:0{i} lb haproxy[1]: 10.0.0.1:99 [15/Feb/2026:10:00:0{i}.1] b s{i % 2} 0/0/0/1 "
    f"{s} 0 -" for i, s in enumerate((500, 502, 200))
]
SYSTEM = ["Feb 15 10:00:00 h kernel: up", "Feb 15 10:00:01 h app: failed", "Feb 15 10:00:02 h a: warn"]
KERNEL = ["[    0.1] eth0: link up", "[    0.2] panic", "[    0.3] warn here"]


@pytest.fixture
def folder(tmp_path):
    for name, content in {
        "web": ["# head"] + WEB, "balancer": BALANCER, "system": SYSTEM, "kernel": KERNEL,
        "other": ["nothing", "known"],
    }.items():
        (tmp_path / f"{name}.log").write_text("\n".join(content) + "\n", encoding="utf-8")
    return tmp_path


def by_name(df, *columns):
    name = F.regexp_extract(df.columns[0], r"(\w+)\.log", 1)
    return {r[0]: tuple(r[1:]) for r in df.select(name, *columns).collect()}


def test_detection_from_heads_and_lines(spark, folder):
    expected = {
        "web": ("nginx",), "balancer": ("haproxy",), "system": ("syslog",), "kernel": ("dmesg",),
        "other": ("unknown",),
    }
    path = str(folder)
    assert by_name(detect_formats(read_lines(spark, path)), "format") == expected
    assert by_name(detect_formats(read_heads(spark, path)), "format") == expected


def test_only_the_head_decides(lines):
    late = lines(*["x"] * 10, WEB[0])
    assert detect_formats(late).collect()[0]["format"] == "unknown"
    assert detect_formats(lines(*["x"] * 9, WEB[0])).collect()[0]["format"] == "nginx"


def test_mixed_files(spark, folder):
    lines = read_lines(spark, str(folder))
    parsed = parse_logs(lines)
    assert by_name(parsed.entries.groupBy("file").count(), "count") == {
        "web": (5,), "balancer": (3,), "system": (3,), "kernel": (3,)
    }
    assert sorted((r["reason"], r["raw"]) for r in parsed.quarantine.collect()) == [
        ("no_match", "# head"), ("unknown_format", "known"), ("unknown_format", "nothing"),
    ]
    assert by_name(report_format_label(parsed.entries), "file_format") == {
        "web": ("Nginx",), "balancer": ("Nginx",), "system": ("Syslog",), "kernel": ("Syslog",)
    }
    with pytest.raises(ValueError):
        parse_logs(lines, "apache")


def test_mixed_and_single_format_agree(spark, folder):
    lines = read_lines(spark, str(folder))
    mixed = parse_logs(lines).entries
    for name, fmt in {"web": "nginx", "balancer": "haproxy", "system": "syslog", "kernel": "dmesg"}.items():
        own = F.col("file").contains(name)
        plain = ["file", "ts", "level", "message", "ip_address", "status_code", "process", "host",
                 "uptime", "network_related", "raw", F.to_json("fields")]
        single = parse_logs(lines.filter(own), fmt).entries.select(*plain)
        both = mixed.filter(own).select(*plain)
        assert single.exceptAll(both).count() == 0 and both.exceptAll(single).count() == 0


@pytest.mark.parametrize("store", [False, True])
def test_analysis_of_files(spark, folder, tmp_path, store):
    target = str(tmp_path / "store") if store else None
    result = analyze_files(spark, str(folder / "*.log"), store=target)
    stats = by_name(
        result.statistics, "total_lines", "error_lines", "error_rate", "ts_min", "file_format"
    )
    assert stats["web"] == (5, 3, 60.0, datetime(2026, 2, 15, 2), "Nginx")
    assert stats["system"] == (3, 1, 33.33, datetime(1900, 2, 15, 10), "Syslog")
    assert stats["kernel"] == (3, 0, 0.0, None, "Syslog")
    assert set(stats) == {"web", "balancer", "system", "kernel"}
    prompts = by_name(result.prompts, "prompt")
    assert "- 错误率: 60.0%" in prompts["web"][0]
    assert "[2026-02-15 02:00:01] GET /1 - 500\n" in prompts["web"][0]
    assert "- 时间范围: None - None" in prompts["kernel"][0]
    sizes = by_name(file_sizes(spark, str(folder / "*.log")), "file_size")
    assert sizes["other"] == (14,)


def test_line_numbers_follow_the_file(spark, tmp_path):
    rows = [f"{i:07d} " + "x" * 40 for i in range(80_000)]
    (tmp_path / "big.log").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1024 * 1024))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1024 * 1024))
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("block_start").distinct().count() == 4
        ordered = [r["value"] for r in lines.orderBy("line_id").select("value").collect()]
        assert ordered == rows
        assert lines.select("line_id").distinct().count() == len(rows)
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        with pytest.raises(ValueError):
            read_lines(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scan_details(spark, tmp_path):
    (tmp_path / "a b.log").write_bytes(b"one\r\ntwo \xff\nthree")
    with gzip.open(tmp_path / "z.log.gz", "wt") as f:
        f.write("".join(f"{i}\n" for i in range(30)))
    path = str(tmp_path)
    lines = read_lines(spark, path)
    assert lines.count() == 33
    assert read_lines(spark, path, max_size=15).count() == 0
    bad = {r["file"].rsplit("/", 1)[1]: r["undecodable_lines"] for r in replaced_bytes(lines).collect()}
    assert bad["a%20b.log"] == 1 and bad["z.log.gz"] == 0
    heads = read_heads(spark, path).groupBy("file").agg(F.collect_list("value").alias("v")).collect()
    shown = {r["file"].rsplit("/", 1)[1]: r["v"] for r in heads}
    assert shown["a%20b.log"] == ["one", "two �", "three"]
    assert shown["z.log.gz"] == [str(i) for i in range(20)]
    assert {r["file"] for r in lines.select("file").distinct().collect()} == {
        r["file"] for r in heads
    }
    assert read_files(spark, f"{path}/*.gz").collect()[0]["content"].startswith("0\n1\n")


EVENTS = ["lost", "2026-01-01 00:00:00,ERROR,a", " at x", "2026-01-01 00:00:01,INFO,b", " y", " z", " w"]


@pytest.mark.parametrize("bits, fan_bits", [(18, 12), (1, 12), (2, 1), (0, 0), (0, 1)])
def test_multiline_events(lines, bits, fan_bits):
    """Chunk borders may fall anywhere."""
    rows = event_lines(lines(*EVENTS), r"\d{4}-", bits, fan_bits).orderBy("event_no", "line_no").collect()
    whole = {}
    for r in rows:
        assert r["line_no"] == len(whole.setdefault(r["event_no"], []))
        whole[r["event_no"]].append(r["value"])
    assert whole == {0: EVENTS[:1], 1: EVENTS[1:3], 2: EVENTS[3:]}


@pytest.mark.parametrize("bits, fan_bits", [(5, 12), (5, 2), (3, 1)])
def test_multiline_chunks_match_brute_force(spark, bits, fan_bits):
    import random

    rng = random.Random(7)
    rows, expected = [], {}
    for file in ("a", "b", "c"):
        number = 0
        for i in range(400):
            start = rng.random() < 0.2
            number += start
            rows.append((file, i * 3, ("S" if start else "-") + str(i)))
            expected.setdefault((file, number), []).append(rows[-1][2])
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "file string, line_id bigint, value string")
    placed = event_lines(df, "S", bits, fan_bits)
    found = {}
    for r in placed.orderBy("file", "event_no", "line_no").collect():
        found.setdefault((r["file"], r["event_no"]), []).append(r["value"])
    assert found == expected
    heads = {(r["file"], r["event_no"]): (r["value"], r["lines"]) for r in event_heads(placed).collect()}
    assert heads == {k: (v[0], len(v)) for k, v in expected.items()}


def test_a_long_event_is_one_entry(spark):
    config = ParserConfig.from_dict(
        {**TEMPLATES["csv_log"], "multiline": True, "multiline_pattern": r"\d{4}-"}
    )
    text = F.when(F.col("id") % 20_000 == 0, "2026-01-01 00:00:00,ERROR,a").otherwise(F.concat(F.lit("  at "), "id"))
    df = spark.range(40_000).select(F.lit("f").alias("file"), F.col("id").alias("line_id"), text.alias("value"))
    parsed = parse_as(multiline_lines(df, config), CustomFormat(config))
    assert parsed.entries.count() == 2 and parsed.quarantine.count() == 0
    sizes = event_heads(event_lines(df, r"\d{4}-", bits=10, fan_bits=2))
    assert {(r["event_no"], r["lines"]) for r in sizes.collect()} == {(1, 20_000), (2, 20_000)}


def test_multiline_chunks_keep_their_number_of_tasks(lines):
    """Tasks are not put together by the compressed size of their lines."""
    plan = event_lines(lines(*EVENTS), r"\d{4}-")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_multiline_entries(lines):
    config = ParserConfig.from_dict(
        {**TEMPLATES["csv_log"], "multiline": True, "multiline_pattern": r"\d{4}-"}
    )
    heads = multiline_lines(lines(*EVENTS), config)
    entries = parse_as(heads, CustomFormat(config)).entries
    assert {r["message"] for r in entries.collect()} == {"a", "b"}
    assert heads.filter("event_no = 1").collect()[0]["lines"] == 2
