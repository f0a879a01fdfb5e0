"""Queries over the command policy and execution plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.policy import (
    Rule, by_category, policy_table, remove_rules, shell_words, upsert_rules, validate_commands,
)
from faultline.plans.command_plan import create_plans
from faultline.workload import render
from faultline.workload.registry import query
from faultline.workload.render import text

# What the rendered commands should be judged, in their order: verdict, program, category, risk
VERDICTS_SQL = """
WITH judged AS (SELECT * FROM (VALUES
  (0, 'allowed', 'ping', 'network', 'low'), (1, 'allowed', 'netstat', 'port', 'low'),
  (2, 'allowed', 'iptables', 'firewall', 'low'), (3, 'allowed', 'dig', 'dns', 'low'),
  (4, 'command_not_allowed', 'rm', NULL, NULL),
  (5, 'command_not_allowed', 'mkfs.ext4', NULL, NULL),
  (6, 'argument_not_allowed', 'nc', 'network', 'medium'), (7, 'allowed', 'curl', 'network', 'low'),
  (8, 'allowed', 'curl', 'network', 'low'), (9, 'command_not_allowed', NULL, NULL, NULL),
  (10, 'command_not_allowed', NULL, NULL, NULL), (11, 'command_not_allowed', NULL, NULL, NULL),
  (12, 'allowed', 'du', 'system', 'low'), (13, 'allowed', 'curl', 'network', 'low'),
  (14, 'allowed', 'nslookup', 'dns', 'low'), (15, 'allowed', 'tcpdump', 'network', 'medium'),
  (16, 'argument_not_allowed', 'tcpdump', 'network', 'medium'),
  (17, 'allowed', 'ps', 'system', 'low'), (18, 'allowed', 'lspci', 'hardware', 'low'),
  (19, 'allowed', 'ss', 'port', 'low'), (20, 'allowed', 'setpci', 'hardware', 'medium'),
  (21, 'allowed', 'systemctl', 'service', 'low'),
  (22, 'argument_not_allowed', 'systemctl', 'service', 'low'),
  (23, 'allowed', 'grep', 'system', 'low'), (24, 'allowed', 'lsof', 'port', 'low')
) j(i, verdict, program, rule_category, risk_level))
"""


def _commands(spark, folder) -> DataFrame:
    return render.events(spark, folder).select(
        "event_id", "user_id", render.command().alias("command_text")
    )


@query("policy_verdict", "C2 C3 C4", VERDICTS_SQL + """
SELECT event_id, verdict, program, rule_category, risk_level
FROM ev JOIN judged ON i = event_id % 25
""")
def policy_verdict(spark, folder) -> DataFrame:
    checked = validate_commands(_commands(spark, folder), policy_table(spark))
    return checked.select("event_id", "verdict", "program", "rule_category", "risk_level")


@query("shell_words", "C2", """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN 'a|b ' || user_id || '|c"d|e' WHEN 1 THEN 'plain|' || user_id
  WHEN 2 THEN 'q uo|te' || event_id || 'd|' WHEN 3 THEN 'x y|\\n|$z' ELSE NULL END AS words
FROM ev
""")
def shell_words_(spark, folder) -> DataFrame:
    ev = render.events(spark, folder)
    user, event = F.col("user_id"), F.col("event_id")
    kind = event % 5
    line = (
        F.when(kind == 0, text("a 'b ", user, "' \"c\\\"d\" e"))
        .when(kind == 1, text(" plain\t", user, " "))
        .when(kind == 2, text("'q 'uo te", event, "\"d\" ''"))
        .when(kind == 3, F.lit("x\\ y \"\\n\" '$'z"))
        .otherwise(text("open \"", user))
    )
    return ev.select("event_id", F.array_join(shell_words(line), "|").alias("words"))


@query("commands_per_category", "C5", VERDICTS_SQL + """
SELECT coalesce(rule_category, 'none') AS category, count(*) AS n,
       count(DISTINCT program) AS programs
FROM ev JOIN judged ON i = event_id % 25 GROUP BY 1
""")
def commands_per_category(spark, folder) -> DataFrame:
    checked = validate_commands(_commands(spark, folder), policy_table(spark))
    return checked.groupBy(F.coalesce("rule_category", F.lit("none")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("program").alias("programs")
    )


@query("policy_by_category", "C5", VERDICTS_SQL.rstrip() + """,
used AS (SELECT rule_category AS category, count(*) AS n FROM ev JOIN judged ON i = event_id % 25 GROUP BY 1),
-- Fixed values: the listing of each category.
listing(category, commands) AS (VALUES
  ('network', 'ping: -c, -w, -W, -i, -s...|traceroute: -n, -m, -w, -q, -I...|tracepath: -n, -m, -p, -l|'
    || 'mtr: -r, -c, -n, -s, -p...|curl: -I, -i, -s, -S, -o...|wget: -q, -O, -o, -T, -t...|nc: -z, -v, -w, -u, -l|'
    || 'ip: addr, link, route, show, list...|ifconfig: -a|arp: -a, -n, -e|route: -n, -ee|'
    || 'ethtool: -i, -k, -S, -s, -a...|tcpdump: -i, -n, -nn, -c, -w...|'
    || 'nmcli: device, connection, show, status, general...|bridge: link, fdb, mdb, vlan'),
  ('port', 'netstat: -t, -u, -l, -n, -p...|ss: -t, -u, -l, -n, -p...|lsof: -i, -P, -n, -p, -u...'),
  ('dns', 'dig: @, +short, +trace, +recurse, +norecurse...|nslookup: -type, -query, -debug|'
    || 'host: -t, -a, -v, -w, -W...'),
  ('system', 'dmesg: -T, -w, -n, -l, -f|journalctl: -u, -n, -f, --since, --until...|top: -b, -n, -p, -u|'
    || 'ps: aux, -ef, -eo, --sort|free: -h, -m, -g, -b, -t...|vmstat: -a, -s, -d, -p|iostat: -c, -d, -k, -m, -x...|'
    || 'df: -h, -H, -T, -i, -l...|du: -h, -s, -a, -d, --max-depth|uptime: |hostname: -f, -i, -I, -s|'
    || 'sysctl: -a, -n|cat: |head: -n|tail: -n, -f|grep: -i, -n, -c, -v, -E...|awk: |sort: -n, -r, -k, -u|'
    || 'uniq: -c, -d|wc: -l, -w, -c'),
  ('firewall', 'iptables: -L, -n, -v, -t, -S...|ip6tables: -L, -n, -v, -t, -S...|ufw: status, status numbered|'
    || 'firewall-cmd: --list-all, --list-services, --list-ports, --state'),
  ('service', 'systemctl: status, is-active, is-enabled, show, list-units|service: status'),
  ('driver', 'lsmod: |modinfo: -n, -F'),
  ('hardware', 'lspci: -v, -vv, -n, -nn, -k...|lshw: -short, -C, -c, -businfo|dmidecode: -t|setpci: -s, -d, -v, -H')
)
SELECT category, commands, coalesce(n, 0) AS n FROM listing LEFT JOIN used USING (category)
""")
def policy_by_category(spark, folder) -> DataFrame:
    """The listings of all categories, and how many of the rendered commands belong to each."""
    used = validate_commands(_commands(spark, folder), policy_table(spark)).groupBy(
        F.col("rule_category").alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))
    listed = by_category(policy_table(spark)).select(
        "category",
        F.array_join(
            F.transform("commands", lambda c: F.concat(c["command"], F.lit(": "), c["allowed_args"])),
            "|",
        ).alias("commands"),
    )
    return listed.join(used, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


CUSTOM_RULES = (
    Rule("rm", "删除", "system", ["-r"], "high"),
    Rule("nc", "Netcat", "network", ["-e", "-z"], "high"),
)


@query("policy_overrides", "C1", VERDICTS_SQL + """
SELECT event_id, CASE i WHEN 4 THEN 'argument_not_allowed' WHEN 6 THEN 'allowed'
         WHEN 17 THEN 'command_not_allowed' ELSE verdict END AS verdict,
       CASE WHEN i IN (4, 6) THEN 'high' WHEN i = 17 THEN NULL ELSE risk_level END AS risk_level
FROM ev JOIN judged ON i = event_id % 25
""")
def policy_overrides(spark, folder) -> DataFrame:
    """Custom rules replace and extend the default ones, and one is taken away."""
    custom = policy_table(spark, CUSTOM_RULES).filter(F.col("command").isin("rm", "nc"))
    policy = upsert_rules(policy_table(spark), custom.withColumnRenamed("position", "seq"))
    policy = remove_rules(policy, spark.createDataFrame([("ps",)], "command string"))
    checked = validate_commands(_commands(spark, folder), policy)
    return checked.select("event_id", "verdict", "risk_level")


def _plans(spark, folder, **options):
    """A plan per user; its targets are the nations of the region the user belongs to."""
    hosts = render.table(spark, folder, "nation").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list("n_name")).alias("targets")
    )
    commands = _commands(spark, folder).select(
        text("p", F.col("user_id")).alias("plan_id"), F.col("event_id").alias("command_idx"),
        F.lit("网络").alias("category"), text("step ", F.col("event_id")).alias("description"),
        F.col("command_text").alias("command"), (F.col("user_id") % 5).alias("n_regionkey"),
    )
    # One row per region.
    commands = commands.join(hosts, "n_regionkey").drop("n_regionkey")
    return create_plans(commands, policy_table(spark), **options)


_PLAN_SQL = VERDICTS_SQL.rstrip() + """,
planned AS (
  SELECT 'p' || user_id AS plan_id, event_id AS command_idx, verdict, user_id % 5 AS region,
         CASE verdict WHEN 'allowed' THEN risk_level ELSE 'unknown' END AS risk_level
  FROM ev JOIN judged ON i = event_id % 25
),
hosts AS (
  SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS targets, count(*) AS n
  FROM nation GROUP BY 1
)
"""


@query("plan_commands", "C6", _PLAN_SQL + """
SELECT plan_id, command_idx, verdict, risk_level, risk_level <> 'low' AS requires_approval, targets
FROM planned JOIN hosts USING (region)
""")
def plan_commands(spark, folder) -> DataFrame:
    return _plans(spark, folder).commands.select(
        "plan_id", "command_idx", "verdict", "risk_level", "requires_approval",
        F.array_join("targets", ",").alias("targets"),
    )


@query("plan_summary", "C6", _PLAN_SQL + """
SELECT plan_id, count(*) AS total_commands, count(*) FILTER (risk_level = 'high') AS high_risk_count,
       bool_or(risk_level <> 'low') AS requires_approval,
       bool_or(verdict = 'argument_not_allowed') AS invalid, CAST(sum(n) AS BIGINT) AS executions
FROM planned JOIN hosts USING (region) GROUP BY 1
""")
def plan_summary(spark, folder) -> DataFrame:
    return _plans(spark, folder).summary


@query("plan_auto_approved", "C6", _PLAN_SQL + """
SELECT plan_id, false AS requires_approval FROM planned JOIN hosts USING (region) GROUP BY 1
""")
def plan_auto_approved(spark, folder) -> DataFrame:
    return _plans(spark, folder, auto_approve=True).summary.select("plan_id", "requires_approval")
