"""Built-in formats, on the edge lines of their rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.operators.dmesg import Dmesg
from faultline.operators.haproxy import HAProxy
from faultline.operators.lineformat import parse_as
from faultline.operators.nginx import Nginx
from faultline.operators.syslog import Syslog
from faultline.streaming.logs import parse_stream, read_line_stream, write_stream

ACCESS = '10.0.0.1 - - [{time}] "{method} {url} HTTP/1.1" {status} 12 "-" "x"'


def entries_of(parsed, *columns):
    rows = parsed.entries.orderBy("line_id").select(*columns).collect()
    return [tuple(r) for r in rows]


def reasons_of(parsed):
    return {r["line_id"]: r["reason"] for r in parsed.quarantine.collect()}


def access(time="15/Feb/2026:10:00:00 +0800", status=200, method="GET", url="/a"):
    return ACCESS.format(time=time, method=method, url=url, status=status)


def test_nginx_levels_and_quarantine(lines):
    parsed = parse_as(
        lines("# comment", access(status=200), access(status=404, method="POST"),
              access(status=502), "", " \t", access(time="31/Feb/2026:10:00:00 +0800")),
        Nginx(),
    )
    assert entries_of(parsed, "line_id", "level", "message", "status_code", "size") == [
        (2, "INFO", "GET /a - 200", 200, 12),
        (3, "WARN", "POST /a - 404", 404, 12),
        (4, "ERROR", "GET /a - 502", 502, 12),
    ]
    assert reasons_of(parsed) == {1: "no_match", 7: "bad_timestamp"}


@pytest.mark.parametrize(
    "shown, expected",
    [
        ("15/Feb/2026:10:00:00 +0800", datetime(2026, 2, 15, 2)),
        ("5/feb/2026:1:2:3 Z", datetime(2026, 2, 5, 1, 2, 3)),
        ("15/Feb/2026:10:00:00.250 +0800", datetime(2026, 2, 15, 10)),
        ("15/Feb/2026:10:00:00", datetime(2026, 2, 15, 10)),
        ("2026-02-15 10:00:00.5", datetime(2026, 2, 15, 10)),
        ("Feb 15 10:00:00", datetime(1900, 2, 15, 10)),
        ("2026-02-15T10:00:00", None),
        ("15/Feb/2026:10:00:60", None),
        ("15/Foo/2026:10:00:00", None),
    ],
)
def test_clock_shapes(lines, shown, expected):
    parsed = parse_as(lines(access(time=shown)), Nginx())
    found = entries_of(parsed, "ts")
    assert found == ([(expected,)] if expected else [])
    assert reasons_of(parsed) == ({} if expected else {1: "bad_timestamp"})


def test_nginx_error_message(lines):
    line = "2026/02/15 10:00:00 [error] 123#123: connection timeout "
    trap = parse_as(lines(line), Nginx())
    clean = parse_as(lines(line), Nginx(compat=False))
    assert entries_of(trap, "level", "message", "ts", "status_code") == [
        ("ERROR", "00:00 [error] 123#123: connection timeout", datetime(2026, 2, 15, 10), None)
    ]
    assert entries_of(clean, "message") == [("123#123: connection timeout",)]


def test_unicode_space_ends_a_word(lines):
    assert reasons_of(parse_as(lines(access(url="/a b")), Nginx())) == {1: "no_match"}


def test_haproxy(lines):
    prefix = "Feb 15 10:00:00 lb haproxy[12]: "
    parsed = parse_as(
        lines(
            prefix + "10.0.0.9:443 [15/Feb/2026:10:00:00.123] back srv 0/0/0/1 503 0 - ----",
            prefix + "fe80::1:443 [15/Feb/2026:10:00:01.123] back srv 0/0/0/1 200 0",
            prefix + "10.0.0.9:443 [15/Feb/2026:10:00:00.123] back srv 0/0/0/-1 503 0",
            prefix + "10.0.0.9:443 [15/Feb/2026:10:00:00.123] back srv 0/0/0/1/2 503 0",
        ),
        HAProxy(),
    )
    assert entries_of(parsed, "line_id", "ts", "level", "message", "ip_address") == [
        (1, datetime(2026, 2, 15, 10), "ERROR", "back -> srv: 503", "10.0.0.9"),
        (2, datetime(2026, 2, 15, 10, 0, 1), "INFO", "back -> srv: 200", "fe80"),
    ]
    assert reasons_of(parsed) == {3: "no_match", 4: "no_match"}


def test_syslog(lines):
    shown = (
        "Feb 5 10:00:00 h p[7]: fatal error",
        "Feb  5 10:00:00 h p: m",
        "<134>1 2026-02-15T10:00:00.123456+08:00 srv kernel 1 - - TCP: overflow",
        "<134>1 2026-02-15T10:00:00+08:00 s p 1 - - m",
        "Feb 29 10:00:00 h p: WARNING low",
    )
    parsed = parse_as(lines(*shown), Syslog())
    assert entries_of(parsed, "line_id", "ts", "level", "host", "process", "message") == [
        (1, datetime(1900, 2, 5, 10), "ERROR", "h", "p[7]", "fatal error"),
        (3, datetime(2026, 2, 15, 10), "INFO", "srv", "kernel", "TCP: overflow"),
    ]
    assert reasons_of(parsed) == {2: "no_match", 4: "bad_timestamp", 5: "bad_timestamp"}

    native = parse_as(lines(*shown), Syslog(compat=False, assume_year=2024))
    assert entries_of(native, "line_id", "ts") == [
        (1, datetime(2024, 2, 5, 10)),
        (3, datetime(2026, 2, 15, 2, 0, 0, 123456)),
        (4, datetime(2026, 2, 15, 2)),
        (5, datetime(2024, 2, 29, 10)),
    ]


def test_dmesg(lines):
    parsed = parse_as(
        lines(
            "[    0.000000] system panic - fatal crash",
            "[Mon Feb 24 10:00:00 2026] systemd[1]: Started",
            "[    1.0] eth0: link up",
            "[    1.0] [err] disk x",
            "[    1.0] [foo] disk x",
            "plain words",
            "[    2.5] net: dev eth1: port 10.1.2.3 exception",
            "[    3.0] debug run",
            "   ",
            "[Xyz Feb 24 10:00:00 2026] odd",
        ),
        Dmesg(),
    )
    assert reasons_of(parsed) == {}
    assert entries_of(
        parsed, "line_id", "ts", "level", "message", "process", "network_related", "device", "dev_ip"
    ) == [
        (1, None, "FATAL", "system panic - fatal crash", "kernel", False, None, None),
        (2, datetime(2026, 2, 24, 10), "INFO", "systemd[1]: Started", "kernel", False, None, None),
        (3, None, "INFO", "link up", "eth0", True, None, None),
        (4, None, "ERROR", "disk x", "kernel", False, None, None),
        (5, None, "INFO", "[foo] disk x", "kernel", False, None, None),
        (6, None, "INFO", "plain words", "kernel", False, None, None),
        (7, None, "ERROR", "dev eth1: port 10.1.2.3 exception", "net", True, "eth1", "10.1.2.3"),
        (8, None, "ERROR", "debug run", "kernel", False, None, None),
        (10, None, "INFO", "odd", "kernel", False, None, None),
    ]
    fields = {r["line_id"]: r["fields"] for r in parsed.entries.collect()}
    assert fields[7] == {
        "uptime": "2.5", "subsystem": "net", "network_related": "true", "device": "eth1",
        "ip_address": "10.1.2.3",
    }
    assert fields[6] == {}


def test_dmesg_times_from_boot(lines):
    boot = F.lit(datetime(2026, 1, 1))
    parsed = parse_as(lines("[    1.5] a", "b"), Dmesg(boot_ts=boot))
    assert entries_of(parsed, "ts", "ts_imputed") == [
        (datetime(2026, 1, 1, 0, 0, 1, 500000), False), (None, True),
    ]


def test_stream_and_batch_agree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.log").write_text(
            "\n".join([access(status=s) for s in (200, 404, 500)] + ["junk"]) + "\n"
        )
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = parse_stream(read_line_stream(spark, str(source), max_files=1), Nginx()).entries
    write_stream(stream, out, checkpoint).awaitTermination()
    columns = ["ts", "level", "message", "raw"]
    streamed = spark.read.parquet(out).select(*columns)
    raw = spark.read.text(str(source)).select(
        F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("line_id"), "value"
    )
    batch = parse_as(raw, Nginx()).entries.select(*columns)
    assert streamed.count() == 9
    assert streamed.exceptAll(batch).count() == 0
