"""Robots rules as tables: parse the texts, pick the group for an agent, judge URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.functions.sql import let, struct
from linkspark.session import lookup_table

DEFAULT_AGENT = "linkspark/1.0"
DEFAULT_DELAY = 1.0

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def robots_groups(robots: DataFrame) -> DataFrame:
    """(host, grp, agents, is_default, rules, crawl_delay) per agent group of each robots text.

    Only texts fetched with status 200 count (a missing ``status`` column means they all were).
    A host has one text: the one fetched last (``fetched_at``, if there is such a column), of equals the
    greatest. The windows run over the lines of a single text, so a group is never larger than one file.
    """
    if "status" in robots.columns:
        robots = robots.filter("status = 200")
    fetched = F.struct(*(["fetched_at"] if "fetched_at" in robots.columns else []), "body")
    robots = robots.groupBy("host").agg(F.max(fetched)["body"].alias("body"))
    lines = robots.select("host", F.posexplode(F.split("body", _LINE_END)).alias("line", "raw"))
    text = F.expr(U.strip("regexp_replace(raw, '#.*$', '')"))
    key = F.lower(F.expr(U.strip("regexp_extract(text, '^([^:]*):', 1)")))
    value = F.expr(let(U.strip("regexp_extract(text, '(?s)^[^:]*:(.*)$', 1)"), U.unquote))
    kind = (F.when(F.col("raw") == "", "blank").when(F.col("key") == "user-agent", "agent")
            .when(F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule"))
    events = (lines.withColumn("text", text).withColumn("key", key).withColumn("value", value)
              .withColumn("kind", kind).filter("kind is not null"))
    file = Window.partitionBy("host").orderBy("line")
    # a rule counts while the last blank-or-agent line was an agent; an agent line after
    # anything but another agent line opens a new group
    opener = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(file)
    opens = (F.col("kind") == "agent") & ~F.lag("kind").over(file).eqNullSafe("agent")
    grouped = (events.withColumn("_open", opener).withColumn("_new", opens.cast("int"))
               .withColumn("grp", F.sum("_new").over(file))
               .filter("kind = 'agent' or (kind = 'rule' and _open = 'agent')"))
    is_rule = F.col("key").isin("allow", "disallow")
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    path = F.expr(U.quote(let(U.split_url("value"), U.join_url)))
    delay = F.when((F.col("key") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("value").cast("int"))
    rule = F.when(is_rule, F.struct(F.col("line").alias("seq"), allow.alias("allow"), path.alias("path")))
    return (grouped.groupBy("host", "grp").agg(
                F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"),
                F.sort_array(F.collect_list(rule)).alias("rules"),
                F.max_by(delay, F.when(delay.isNotNull(), F.col("line"))).alias("crawl_delay"),
                F.bool_or(F.col("kind") == "rule").alias("_used"))
            .filter("_used").drop("_used")
            .withColumn("is_default", F.array_contains("agents", "*")))


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per rule; groups that only set a delay keep one row without a rule."""
    return (robots_groups(robots).select("*", F.explode_outer("rules").alias("_r"))
            .select("host", "grp", "agents", "is_default", "_r.seq", "_r.allow", "_r.path", "crawl_delay"))


def robots_policy(groups: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """(host, rules, crawl_delay) of the group that applies to ``agent``: named groups first."""
    token = agent.split("/")[0].lower()
    named = F.exists("agents", lambda a: F.lit(token).contains(a))
    return (groups.filter(F.col("is_default") | named)
            .groupBy("host").agg(F.min_by(F.struct("rules", "crawl_delay"), F.struct("is_default", "grp")).alias("_g"))
            .select("host", "_g.*"))


def rule_target(url: str) -> str:
    """What rules are matched against: percent-quoted path, parameters, query and fragment."""
    def rest(u: str) -> str:
        return struct(scheme="''", netloc="''", **{f: f"{u}.{f}" for f in U.PARTS[2:]})
    target = U.quote(let(let(U.split_url(U.unquote(url)), rest), U.join_url))
    return f"coalesce(nullif({target}, ''), '/')"


def prefix_index(groups: DataFrame, agent: str = DEFAULT_AGENT) -> tuple[DataFrame, DataFrame]:
    """(host, prefix, first): for every prefix that a host has rules on the first of them, as (seq, allow); and
    (host, lengths): the lengths of a host's prefixes. ``*`` alone is the empty prefix."""
    policy = lookup_table(robots_policy(groups, agent).select("host", "rules"))
    rules = policy.select("host", F.inline("rules")).select(
        F.col("host").alias("_host"), F.when(F.col("path") == "*", "").otherwise(F.col("path")).alias("_prefix"), "seq", "allow")
    first = rules.groupBy("_host", "_prefix").agg(F.min(F.struct("seq", "allow")).alias("_first"))
    lengths = rules.groupBy("_host").agg(F.array_sort(F.collect_set(F.length("_prefix"))).alias("_lengths"))
    return first, lengths


def robots_allowed(urls: DataFrame, groups: DataFrame, agent: str = DEFAULT_AGENT,
                   col: str = "url", respect: bool = True) -> DataFrame:
    """Add ``allowed``: what the first matching rule in file order says, else yes.

    A URL looks up its own prefixes, of the lengths that its host has rules on, in an index of prefixes; a host's
    rules are never copied to its URLs, however many there are. URLs of one target are looked up once.
    """
    if not respect:
        return urls.withColumn("allowed", F.lit(True))
    first, lengths = prefix_index(groups, agent)
    judged = urls.withColumn("_host", F.expr(U.host(col))).withColumn("_target", F.expr(rule_target(col)))
    asked = judged.select("_host", "_target").distinct().join(lengths, "_host")
    own = F.transform(F.filter("_lengths", lambda n: n <= F.length("_target")), lambda n: F.substring(F.col("_target"), F.lit(1), n))
    met = asked.select("_host", "_target", F.explode(own).alias("_prefix")).join(first, ["_host", "_prefix"])
    verdicts = lookup_table(met.groupBy("_host", "_target").agg(F.min("_first")["allow"].alias("_allow")))
    return (judged.join(verdicts, ["_host", "_target"], "left")
            .withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_host", "_target", "_allow").select(*urls.columns, "allowed"))


def crawl_delays(hosts: DataFrame, groups: DataFrame, agent: str = DEFAULT_AGENT,
                 default: float = DEFAULT_DELAY) -> DataFrame:
    """Add ``crawl_delay`` seconds to a table with ``host``; zero or no directive means the default."""
    delays = robots_policy(groups, agent).select("host", F.col("crawl_delay").alias("_delay"))
    given = F.when(F.col("_delay") > 0, F.col("_delay").cast("double"))
    return (hosts.join(delays, "host", "left")
            .withColumn("crawl_delay", F.coalesce(given, F.lit(float(default)))).drop("_delay"))
