"""Headline queries, timed. Prints one JSON line.

Every query is run once to warm up and then timed; its result goes to a sink that keeps nothing.
``parse_*`` and ``statistics_*`` work on log files rendered beforehand, so that their lines per
second tell the speed of the library and not of the rendering; ``scan`` reads the same files only.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from faultline.operators.dmesg import Dmesg
from faultline.operators.haproxy import HAProxy
from faultline.operators.lineformat import parse_as
from faultline.operators.nginx import Nginx
from faultline.operators.stats import log_statistics
from faultline.operators.syslog import Syslog
from faultline.session import build_session
from faultline.sources.lines import read_lines
from faultline.workload import all_queries, render

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
QUERIES = (
    "nginx_access", "nginx_error", "haproxy_backends", "syslog_rfc3164", "dmesg_entries",
    "custom_format", "multiline_events", "detect_formats", "mixed_parse", "log_statistics",
    "prompt_context", "markdown_report", "findings", "policy_verdict", "plan_summary",
    "stop_on_error", "pending_commands", "audit_query", "audit_statistics", "recent_memory",
    "hypothesis_state", "memory_summary", "diagnosis_report",
)
#: Each event is written this often, so that a file is worth splitting.
COPIES = 5


def timed(make) -> float:
    best = float("inf")
    for run in range(2):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if run:
            best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        spark__sql__shuffle__partitions=str(CPUS), spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    seconds = {name: timed(lambda: registered[name].run(spark, FOLDER)) for name in QUERIES}

    formats = {
        "nginx": (render.nginx_access(), Nginx()), "haproxy": (render.haproxy(), HAProxy()),
        "syslog": (render.syslog_3164(), Syslog()), "dmesg": (render.dmesg(), Dmesg()),
    }
    rates = {}
    with tempfile.TemporaryDirectory(prefix="faultline-bench-") as folder:
        rendered = render.events(spark, FOLDER).select(
            "*", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
        )
        for name, (line, fmt) in formats.items():
            path = f"{folder}/{name}"
            rendered.select(line.alias("value")).write.text(path)
            lines = read_lines(spark, path)
            count = lines.count()
            entries = parse_as(lines, fmt).entries
            parts = {"scan": lines, "parse": entries, "statistics": log_statistics(entries)}
            for step, df in parts.items():
                taken = timed(lambda: df)
                seconds[f"{step}_{name}"] = taken
                rates[f"{step}_{name}"] = round(count / taken)
    print(json.dumps({
        "metric": "total warm time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "lines_per_sec": rates,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cores": CPUS,
        "warm_up_runs": 1,
    }))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
