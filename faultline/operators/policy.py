"""Which shell commands may run: the policy table and the check of commands against it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.pyregex import translate
from faultline.schema import POLICY

ALLOWED = "allowed"
COMMAND_NOT_ALLOWED = "command_not_allowed"
ARGUMENT_NOT_ALLOWED = "argument_not_allowed"

#: A policy built from Python rows is broadcast up to this size.
BROADCAST_ROWS = 10_000
#: Different patterns that a policy may have; each becomes a constant of the plan.
PATTERNS = 2000


@dataclass(frozen=True)
class Rule:
    command: str
    description: str
    category: str
    allowed_args: Sequence[str] = field(default_factory=list)
    risk_level: str = "low"
    requires_sudo: bool = False
    allowed_patterns: Sequence[str] = field(default_factory=list)


# The commands known by default. A command named twice keeps the later rule.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("ping", "测试网络连通性", "network", ["-c", "-w", "-W", "-i", "-s", "-q", "-n"],
         allowed_patterns=[r"-c\s+\d+", r"-w\s+\d+", r"-W\s+\d+"]),
    Rule("traceroute", "路由追踪", "network", ["-n", "-m", "-w", "-q", "-I", "-T", "-U"],
         allowed_patterns=[r"-m\s+\d+", r"-w\s+\d+"]),
    Rule("tracepath", "MTU路径发现", "network", ["-n", "-m", "-p", "-l"],
         allowed_patterns=[r"-m\s+\d+", r"-p\s+\d+"]),
    Rule("mtr", "网络诊断工具", "network", ["-r", "-c", "-n", "-s", "-p", "-T", "-u"],
         allowed_patterns=[r"-c\s+\d+", r"-s\s+\d+", r"-p\s+\d+"]),
    Rule("curl", "HTTP请求测试", "network",
         ["-I", "-i", "-s", "-S", "-o", "-O", "-w", "-H", "-X", "-m", "--connect-timeout",
         "--max-time", "-k", "-L", "-v", "-d"],
         allowed_patterns=[r"-m\s+\d+", r"--connect-timeout\s+\d+", r"--max-time\s+\d+",
                           r"-H\s+['\"][^'\"]+['\"]", r"-w\s+['\"][^'\"]+['\"]"]),
    Rule("wget", "HTTP下载测试", "network",
         ["-q", "-O", "-o", "-T", "-t", "--spider", "-S", "--no-check-certificate"],
         allowed_patterns=[r"-T\s+\d+", r"-t\s+\d+"]),
    Rule("nc", "Netcat网络工具", "network", ["-z", "-v", "-w", "-u", "-l"], "medium",
         allowed_patterns=[r"-w\s+\d+"]),
    Rule("netstat", "网络连接统计", "port", ["-t", "-u", "-l", "-n", "-p", "-a", "-r", "-i", "-s"]),
    Rule("ss", "Socket统计", "port", ["-t", "-u", "-l", "-n", "-p", "-a", "-r", "-s", "-o", "-m",
         "-i", "-4", "-6"]),
    Rule("lsof", "列出打开文件", "port", ["-i", "-P", "-n", "-p", "-u", "-t"], requires_sudo=True,
         allowed_patterns=[r"-i\s*(:\d+|tcp|udp)", r"-p\s+\d+"]),
    Rule("dig", "DNS查询", "dns",
         ["@", "+short", "+trace", "+recurse", "+norecurse", "ANY", "A", "AAAA", "MX", "NS", "TXT",
         "SOA", "CNAME", "PTR", "-x"]),
    Rule("nslookup", "DNS查询工具", "dns", ["-type", "-query", "-debug"],
         allowed_patterns=[r"-type=\w+", r"-query=\w+"]),
    Rule("host", "DNS查询", "dns", ["-t", "-a", "-v", "-w", "-W", "-R"],
         allowed_patterns=[r"-t\s+\w+", r"-R\s+\d+"]),
    Rule("systemctl", "系统服务管理", "service",
         ["status", "is-active", "is-enabled", "list-units", "show"],
         allowed_patterns=[r"status\s+\S+"]),
    Rule("service", "服务状态", "service", ["status"]),
    Rule("iptables", "防火墙规则查看", "firewall", ["-L", "-n", "-v", "-t", "-S", "--line-numbers"],
         requires_sudo=True),
    Rule("ip6tables", "IPv6防火墙规则", "firewall", ["-L", "-n", "-v", "-t", "-S", "--line-numbers"],
         requires_sudo=True),
    Rule("ufw", "UFW防火墙状态", "firewall", ["status", "status numbered"], requires_sudo=True),
    Rule("firewall-cmd", "firewalld管理", "firewall",
         ["--list-all", "--list-services", "--list-ports", "--state"], requires_sudo=True),
    Rule("dmesg", "内核消息", "system", ["-T", "-w", "-n", "-l", "-f"],
         allowed_patterns=[r"-n\s+\d+", r"-l\s+[\w,]+", r"-f\s+\w+"]),
    Rule("journalctl", "系统日志", "system",
         ["-u", "-n", "-f", "--since", "--until", "-p", "-k", "-b", "--no-pager"],
         allowed_patterns=[r"-u\s+\S+", r"-n\s+\d+", r"-p\s+\w+",
                           r"--since\s+['\"][^'\"]+['\"]"]),
    Rule("top", "进程监控", "system", ["-b", "-n", "-p", "-u"],
         allowed_patterns=[r"-n\s+\d+", r"-p\s+\d+"]),
    Rule("ps", "进程状态", "system", ["aux", "-ef", "-eo", "--sort"]),
    Rule("free", "内存状态", "system", ["-h", "-m", "-g", "-b", "-t", "-s"]),
    Rule("vmstat", "虚拟内存统计", "system", ["-a", "-s", "-d", "-p"]),
    Rule("iostat", "IO统计", "system", ["-c", "-d", "-k", "-m", "-x", "-t"]),
    Rule("df", "磁盘使用", "system", ["-h", "-H", "-T", "-i", "-l", "-a"]),
    Rule("du", "目录大小", "system", ["-h", "-s", "-a", "-d", "--max-depth"],
         allowed_patterns=[r"-d\s+\d+", r"--max-depth=\d+"]),
    Rule("uptime", "系统运行时间", "system"),
    Rule("hostname", "主机名", "system", ["-f", "-i", "-I", "-s"]),
    Rule("ip", "网络配置", "network",
         ["addr", "link", "route", "show", "list", "neigh", "maddr", "rule", "netns", "-4", "-6",
         "-0", "-d", "-r", "-n", "-b", "-c", "-v", "-s", "-h", "-o", "-t", "-rc", "-oneline",
         "-details", "-statistics", "-human"],
         allowed_patterns=[r"-4", r"-6", r"-0", r"addr\s+show", r"link\s+show", r"route\s+show",
                           r"maddr\s+show", r"neigh\s+show"]),
    Rule("ifconfig", "网络接口配置", "network", ["-a"]),
    Rule("arp", "ARP缓存", "network", ["-a", "-n", "-e"]),
    Rule("route", "路由表", "network", ["-n", "-ee"]),
    Rule("ethtool", "网卡工具", "network", ["-i", "-k", "-S", "-s", "-a", "-c", "-g"]),
    Rule("tcpdump", "网络抓包", "network", ["-i", "-n", "-nn", "-c", "-w", "-r", "-v", "-vv", "-X",
         "-s", "-e"], "medium",
         True, [r"-i\s+\w+", r"-c\s+\d+", r"-w\s+\S+", r"-s\s+\d+"]),
    Rule("lsmod", "列出已加载模块", "driver"),
    Rule("modinfo", "模块信息", "driver", ["-n", "-F"], allowed_patterns=[r"-F\s+\w+"]),
    Rule("lspci", "PCI设备列表", "hardware", ["-v", "-vv", "-n", "-nn", "-k", "-s"],
         allowed_patterns=[r"-s\s+[\da-fA-F:.]+", r"-v+", r"-nn"]),
    Rule("lshw", "硬件信息", "hardware", ["-short", "-C", "-c", "-businfo"],
         allowed_patterns=[r"-C\s+\w+", r"-c\s+\w+"]),
    Rule("dmidecode", "DMI信息", "hardware", ["-t"], requires_sudo=True,
         allowed_patterns=[r"-t\s+\d+"]),
    Rule("ethtool", "网卡诊断工具", "network",
         ["-i", "-k", "-S", "-s", "-a", "-c", "-g", "-m", "-d", "-e", "-r", "-p", "-t", "-T"],
         allowed_patterns=[r"-m\s+\w+", r"-d\s+\w+", r"-S\s+\w+", r"-i\s+\w+", r"-k\s+\w+"]),
    Rule("sysctl", "内核参数", "system", ["-a", "-n"],
         allowed_patterns=[r"-a", r"-n", r"net\.\S+", r"kernel\.\S+"]),
    Rule("nmcli", "NetworkManager CLI", "network",
         ["device", "connection", "show", "status", "general", "-p", "-f", "-t"],
         allowed_patterns=[r"device\s+show", r"device\s+status", r"connection\s+show",
                           r"general\s+status", r"-f\s+[\w,]+"]),
    Rule("cat", "查看文件内容", "system"),
    Rule("head", "文件头部", "system", ["-n"], allowed_patterns=[r"-n\s+\d+"]),
    Rule("tail", "文件尾部", "system", ["-n", "-f"], allowed_patterns=[r"-n\s+\d+"]),
    Rule("grep", "文本搜索", "system", ["-i", "-n", "-c", "-v", "-E", "-r", "-l"]),
    Rule("awk", "文本处理", "system"),
    Rule("sort", "排序", "system", ["-n", "-r", "-k", "-u"]),
    Rule("uniq", "去重", "system", ["-c", "-d"]),
    Rule("wc", "统计", "system", ["-l", "-w", "-c"]),
    Rule("setpci", "PCI配置空间", "hardware", ["-s", "-d", "-v", "-H"], "medium",
         allowed_patterns=[r"-s\s+[\da-fA-F:.]+", r"-d\s+[\da-fA-F:]+", r"VENDOR_ID",
                           r"DEVICE_ID"]),
    Rule("bridge", "网桥管理", "network", ["link", "fdb", "mdb", "vlan"]),
    Rule("systemctl", "系统服务状态", "service",
         ["status", "is-active", "is-enabled", "show", "list-units"],
         allowed_patterns=[r"status\s+\S+", r"show\s+\S+", r"is-active\s+\S+",
                           r"is-enabled\s+\S+"]),
)


def policy_table(spark: SparkSession, custom: Sequence[Rule] = ()) -> DataFrame:
    """The policy with ``position``: default rules overridden and extended by ``custom`` ones.

    A command keeps the position of its first rule and the content of its last. The patterns of
    rules are Python's; the table holds them in Java syntax. A pattern without a Java counterpart
    raises.
    """
    rules: dict[str, Rule] = {}
    for rule in (*DEFAULT_RULES, *custom):
        rules[rule.command] = replace(
            rule, allowed_patterns=[translate(p) for p in rule.allowed_patterns]
        )
    table = spark.createDataFrame(
        [(i, *astuple(rule)) for i, rule in enumerate(rules.values())],
        "position int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POLICY.fields),
    )
    return F.broadcast(table) if len(rules) <= BROADCAST_ROWS else table


def upsert_rules(policy: DataFrame, rules: DataFrame) -> DataFrame:
    """The policy with further rules added or replaced; ``rules`` need ``seq`` for their order.

    ``allowed_patterns`` of both are in Java syntax, as :func:`policy_table` makes them. Positions
    are numbered anew; a policy is configuration, small enough for that.
    """
    base = policy.withColumnRenamed("position", "seq").withColumn("_late", F.lit(0))
    both = base.unionByName(rules.withColumn("_late", F.lit(1)))
    names = [f.name for f in POLICY.fields if f.name != "command"]
    order = F.struct("_late", "seq")
    return (
        both.groupBy("command")
        .agg(
            F.min(order).alias("_first"),
            F.max_by(F.struct(*names), order).alias("_rule"),
        )
        .select(
            # Commands that are new come after all that were there.
            (F.row_number().over(Window.orderBy("_first", "command")) - 1).alias("position"),
            "command", *[F.col(f"_rule.{n}").alias(n) for n in names],
        )
    )


def remove_rules(policy: DataFrame, commands: DataFrame) -> DataFrame:
    """The policy without the named commands."""
    return policy.join(commands.select("command").distinct(), "command", "left_anti")


# Quoted, double-quoted and escaped pieces of a shell word, and plain text.
_PIECES = r"""'[^']*+'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|\\[\s\S]|[^ \t\r\n'"\\]++"""


def shell_words(command: Column) -> Column:
    """Words of a command line by POSIX shell quoting; NULL when a quote or escape stays open."""
    plain = F.filter(F.split(command, r"[ \t\r\n]+"), lambda w: w != "")
    quoted = command.rlike(r"""['"\\]""")
    # Only an unfinished quote or escape is left when all complete pieces are taken away.
    broken = F.regexp_replace(command, F.lit(_PIECES), F.lit("")).rlike(r"""['"\\]""")

    def unquote(piece: Column) -> Column:
        inner = F.substring(piece, 2, F.length(piece) - 2)
        return (
            F.when(piece.startswith("'"), inner)
            .when(
                piece.startswith('"'),
                F.regexp_replace(inner, F.lit(r"""\\(["\\])"""), F.lit("$1")),
            )
            .when(piece.startswith("\\"), F.substring(piece, 2, F.length(piece)))
            .otherwise(piece)
        )

    def word(raw: Column) -> Column:
        pieces = F.regexp_extract_all(raw, F.lit(f"({_PIECES})"), F.lit(1))
        return F.array_join(F.transform(pieces, unquote), "")

    words = F.transform(F.regexp_extract_all(command, F.lit(f"((?:{_PIECES})+)"), F.lit(1)), word)
    return F.when(~quoted, plain).when(~broken, words)


def _argument_allowed(arg: Column, allowed: Column, flags: Column, numbers: Column, patterns: list[str]) -> Column:
    """Whether one argument passes.

    ``flags`` are the rule's one-letter options in a row, ``numbers`` those of its ``patterns``.
    """
    option = arg.startswith("-")
    # Taking the rule's flags away leaves nothing of a bundle of them.
    bundle = (
        ~arg.startswith("--") & (F.length(arg) > 2)
        & (F.call_function("translate", F.substring(arg, 2, F.length(arg)), flags, F.lit("")) == "")
    )
    base = F.substring_index(arg, "=", 1)
    with_value = arg.contains("=") & F.exists(allowed, lambda a: F.startswith(a, base))

    def matches(number: Column) -> Column:
        """Each pattern is a constant of its own, compiled once."""
        chain = F
        for i, pattern in enumerate(patterns):
            chain = chain.when(number == i, arg.rlike(f"(?Ud)^(?:{pattern})"))
        return chain.otherwise(False)

    by_pattern = F.exists(numbers, matches) if patterns else F.lit(False)
    return ~option | F.array_contains(allowed, arg) | bundle | with_value | by_pattern


def _patterns(policy: DataFrame) -> list[str]:
    """The distinct patterns of a policy, which is configuration: more than ``PATTERNS`` are refused."""
    found = policy.select(F.explode("allowed_patterns").alias("p")).distinct().limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"a policy may have {PATTERNS} different patterns")
    return sorted(r["p"] for r in found if r["p"] is not None)


def _indexed(policy: DataFrame, patterns: list[str]) -> DataFrame:
    """Rules with their one-letter options as one text and the numbers of their patterns."""
    single = F.filter("allowed_args", lambda a: a.startswith("-") & (F.length(a) == 2))
    flags = F.array_join(F.transform(single, lambda a: F.substring(a, 2, 1)), "")
    known = F.array(*map(F.lit, patterns)).cast("array<string>")
    numbers = F.transform(
        F.filter("allowed_patterns", lambda p: p.isNotNull()), lambda p: F.array_position(known, p).cast("int") - 1
    )
    return policy.withColumn("_flags", F.coalesce(flags, F.lit(""))).withColumn(
        "_numbers", F.coalesce(numbers, F.array().cast("array<int>"))
    )


def validate_commands(
    commands: DataFrame, policy: DataFrame, text: str = "command_text"
) -> DataFrame:
    """Commands with ``verdict`` and the policy row of their program.

    Every word that does not start with ``-`` passes, pipes and redirections included.
    """
    words = F.col("_words")
    parsed = commands.withColumn("_all", shell_words(F.col(text)))
    sudo = F.coalesce(F.get("_all", F.lit(0)) == "sudo", F.lit(False))
    parsed = parsed.withColumn(
        "_words", F.when(sudo, F.slice("_all", 2, F.size("_all"))).otherwise(F.col("_all"))
    ).withColumn("program", F.get(words, F.lit(0)))
    args = F.slice(words, 2, F.size(words))
    patterns = _patterns(policy)
    rules = _indexed(policy, patterns).select(
        F.col("command").alias("program"), "allowed_args", "_flags", "_numbers", F.lit(True).alias("_listed"),
        F.col("description").alias("rule_description"), F.col("category").alias("rule_category"),
        "risk_level", "requires_sudo",
    )
    fine = F.forall(
        args, lambda a: _argument_allowed(
            a, F.col("allowed_args"), F.col("_flags"), F.col("_numbers"), patterns
        )
    )
    verdict = (
        F.when(F.col("_listed").isNull(), COMMAND_NOT_ALLOWED)
        .when(fine, ALLOWED)
        .otherwise(ARGUMENT_NOT_ALLOWED)
    )
    return parsed.join(rules, "program", "left").select(
        *commands.columns, "program", verdict.alias("verdict"),
        "rule_description", "rule_category", "risk_level", "requires_sudo",
    )


def by_category(policy: DataFrame) -> DataFrame:
    """``category, commands``: one row per category with its commands, as listings show them.

    The argument text names the first five allowed ones and ends in dots when there are more.
    """
    shown = F.concat(
        F.array_join(F.slice("allowed_args", 1, 5), ", "),
        F.when(F.size("allowed_args") > 5, "...").otherwise(""),
    )
    row = F.struct(
        "position", "command", "description", "risk_level", shown.alias("allowed_args")
    )
    return policy.groupBy("category").agg(F.array_sort(F.collect_list(row)).alias("commands"))
