"""Custom formats, templates and their configuration."""

import re
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultline.functions.clock import TimeFormat, UnsupportedFormat
from faultline.functions.pyregex import optional_groups, translate
from faultline.operators.custom import CustomFormat, ParseError, ParserConfig
from faultline.operators.detect import detect_custom
from faultline.operators.lineformat import parse_as
from faultline.operators.templates import TEMPLATES, builtin_format, list_templates
from faultline.plans.analysis import analyze_files
from faultline.sources.configs import load_config, load_configs


def parse(lines, config, *values):
    parsed = parse_as(lines(*values), CustomFormat(ParserConfig.from_dict(config)))
    rows = parsed.entries.orderBy("line_id").collect()
    return [(r["ts"], r["level"], r["message"], r["fields"]) for r in rows], parsed


def test_documented_example(lines):
    config = {
        "pattern": r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (\w+): (.*)",
        "level_group": 2, "message_group": 3,
    }
    rows, parsed = parse(
        lines, config, "[2026-02-14 10:30:00] ERROR: Connection timeout to 192.168.1.100", "other"
    )
    assert rows == [
        (datetime(2026, 2, 14, 10, 30), "ERROR", "Connection timeout to 192.168.1.100", {})
    ]
    assert [r["reason"] for r in parsed.quarantine.collect()] == ["no_match"]


def test_field_rules(lines):
    config = {
        "pattern": r"(\S+) n=(\S+) b=(\w*)( x)? (.*)",
        "message_group": 9,
        "field_mappings": [
            {"name": "n", "pattern_group": 2, "transform": "int", "default": 7},
            {"name": "f", "pattern_group": 2, "transform": "float"},
            {"name": "b", "pattern_group": 3, "transform": "bool"},
            {"name": "x", "pattern_group": 4},
            {"name": "last"},
            {"name": "none", "pattern_group": 12},
        ],
    }
    rows, _ = parse(lines, config, "t n=1_000 b=YES x end", "t n=2.5 b= end", "t n=zz b=no end")
    assert [r[3] for r in rows] == [
        {"n": "1000", "b": "true", "x": " x", "last": "end"},
        {"n": "7", "f": "2.5", "b": "false", "last": "end"},
        {"n": "7", "b": "false", "last": "end"},
    ]
    assert all(r[0] is None and r[1] == "INFO" and r[2] == "" for r in rows)


def test_level_mapping_looks_up_upper_case(lines):
    config = {
        "pattern": r"(\w*)\|(.*)", "level_group": 1, "timestamp_group": 5,
        "level_mapping": {"NOTE": "AUDIT", "low": "NEVER"},
    }
    rows, _ = parse(lines, config, "note|a", "low|b", "err|c", "|d")
    assert [r[1] for r in rows] == ["AUDIT", "INFO", "ERROR", "INFO"]


def test_templates(lines, spark):
    assert [r["template"] for r in list_templates(spark).orderBy("position").collect()] == [
        "apache_access", "apache_error", "json_log", "csv_log", "generic_log"
    ]
    assert builtin_format("missing") is None
    line = '{"time":"2026-02-15T10:00:00","level":"error","message":"m"}'
    compat = parse_as(lines(line), builtin_format("json_log")).entries.collect()[0]
    native = parse_as(lines(line), builtin_format("json_log", compat=False)).entries.collect()[0]
    assert (compat["ts"], compat["level"], compat["message"]) == (None, "INFO", line)
    assert (native["ts"], native["level"], native["message"]) == (
        datetime(2026, 2, 15, 10), "ERROR", "m"
    )


def test_detection(lines, spark):
    shown = lines("x", "2026-01-01 00:00:00,INFO,a", "", "2026-01-01 00:00:00,INFO,b")
    csv = ParserConfig.from_dict(TEMPLATES["csv_log"])
    assert detect_custom(shown, csv).collect()[0]["detected"]
    half = lines("x", "2026-01-01 00:00:00,INFO,a")
    assert not detect_custom(half, csv).collect()[0]["detected"]
    marked = ParserConfig.from_dict({"pattern": "(a)", "detect_patterns": ["(", "needle"]})
    hay = lines(*["hay"] * 19, "a needle")
    assert detect_custom(hay, marked).collect()[0]["detected"]
    assert not detect_custom(lines(*["hay"] * 20, "needle"), marked).collect()[0]["detected"]


def test_configuration_files(tmp_path):
    (tmp_path / "b.yaml").write_text("name: b\npattern: '(a)(b)'\n")
    (tmp_path / "a.yml").write_text("name: a\npattern: '(a)'\nmultiline: true\n")
    (tmp_path / "bad.yaml").write_text("name: x\npattern: '('\n")
    (tmp_path / "worse.yaml").write_text("a: [")
    assert [c.name for c in load_configs(tmp_path)] == ["b", "a"]
    assert load_configs(tmp_path / "none") == []
    for name in ("bad.yaml", "worse.yaml", "none.yaml"):
        with pytest.raises(ParseError):
            load_config(tmp_path / name)


def test_a_folder_of_formats_is_parsed_in_one_scan(spark, tmp_path):
    folder = tmp_path / "formats"
    folder.mkdir()
    (folder / "a.yaml").write_text("name: a\npattern: '(\\S+ \\S+) A (.*)'\n")
    (folder / "b.yaml").write_text("name: b\npattern: 'b=(\\w+) at (\\d+)'\ntimestamp_format: '%Y%m%d'\n"
                                   "timestamp_group: 2\nmessage_group: 1\nlevel_group: 1\n")
    (folder / "c.yaml").write_text("name: c\npattern: '(.*);(.*);(.*)'\ndetect_patterns: [';;']\n"
                                   "field_mappings: [{name: n, pattern_group: 2, transform: int, default: -1}]\n")
    (folder / "d.yaml").write_text("name: d\npattern: 'never (x)'\n")
    (folder / "e.yaml").write_text("name: syslog\npattern: '<s>(.*)'\nmessage_group: 1\n")
    logs = {
        "a.log": ["2026-01-02 03:04:05 A one", "2026-13-02 03:04:05 A no time", "", "none"],
        "b.log": ["b=error at 20260102", "b=x at 2026", "b=", "b=warn at 20260203"],
        "c.log": ["x;;y", "2026-01-02 03:04:05;7;z", "not"],
        "s.log": ["<s>1", "<s>2"],
        "n.log": ['1.2.3.4 - - [02/Jan/2026:03:04:05 +0000] "GET /x HTTP/1.1" 500 12'],
        "u.log": ["?", "!"],
    }
    for name, shown in logs.items():
        (tmp_path / name).write_text("\n".join(shown) + "\n")
    configs = load_configs(folder)
    found = analyze_files(spark, str(tmp_path / "*.log"), configs=configs)
    plan = found.entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan

    def rows(table):
        return sorted((r["file"].rsplit("/", 1)[-1], *map(str, r[2:])) for r in table.collect())

    names = {"a.log": "a", "b.log": "b", "c.log": "c", "s.log": "syslog", "n.log": "nginx"}
    single = [analyze_files(spark, str(tmp_path / f), fmt=n, configs=configs) for f, n in names.items()]
    assert rows(found.entries) == sorted(r for one in single for r in rows(one.entries))
    lost = rows(found.quarantine)
    assert [r for r in lost if r[0] != "u.log"] == sorted(r for one in single for r in rows(one.quarantine))
    assert [r[-1] for r in lost if r[0] == "u.log"] == ["unknown_format"] * 2
    with pytest.raises(ValueError, match="names"):
        analyze_files(spark, str(tmp_path / "*.log"), configs=[configs[0], configs[0]])


def test_dialect():
    assert translate(r"(?P<a>x[^[&]{,3})(?P=a)\Z") == r"(x[^\[\&]{0,3})(?:\1)\z"
    assert optional_groups(r"(a|(b))(c)?(?:(d)|e)(?P<x>f)") == {2, 3, 4}
    with pytest.raises(re.error):
        translate("(")
    with pytest.raises(UnsupportedFormat):
        translate("(a)?(?(1)b|c)")
    with pytest.raises(UnsupportedFormat):
        TimeFormat.compile("%U")


FORMATS = [
    "%Y-%m-%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z", "%b %d %H:%M:%S", "%d.%m.%y %I:%M:%S %p",
    "%A, %d %B %Y %H:%M", "%Y%m%dT%H%M%S.%f", "%j %Y", "%a %b %d %H:%M:%S.%f %Y",
]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    times=st.lists(
        st.datetimes(datetime(1970, 1, 1), datetime(2060, 12, 31)), min_size=20, max_size=40
    ),
)
def test_time_formats_agree_with_strptime(spark, times):
    rows = []
    for text in FORMATS:
        for t in times:
            shown = t.replace(tzinfo=timezone.utc).strftime(text)
            if "%Y" not in text and "%y" not in text and t.month == 2 and t.day == 29:
                continue
            expected = datetime.strptime(shown, text)
            if expected.tzinfo:
                expected = expected.astimezone(timezone.utc).replace(tzinfo=None)
            rows.append((text, shown, expected))
    df = spark.createDataFrame([r[:2] for r in rows], "format string, shown string")
    columns = {text: TimeFormat.compile(text).parse(df["shown"]) for text in FORMATS}
    from pyspark.sql import functions as F

    chosen = F.coalesce(*[F.when(df["format"] == t, c) for t, c in columns.items()])
    found = df.select("format", "shown", chosen.cast("timestamp_ntz").alias("ts")).collect()
    assert {(r[0], r[1]): r[2] for r in found} == {(f, s): e for f, s, e in rows}
