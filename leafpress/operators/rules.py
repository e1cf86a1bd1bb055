"""Site rules: matching, stages, and the life of a rule from testing to production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.functions.text import bare_url
from leafpress.sources.store import DELETED, VALID, upsert

RULE = (
    "host string, host_name string, bodies array<string>, noises array<string>, author string, pub_time string, title string, reserved_nodes array<string>, "
    "no_semantic_denoise boolean, need_browser_crawl boolean, body_use_rule_only boolean, create_time timestamp, update_time timestamp, status int, stage int"
)
TESTING, PRODUCTION = 0, 1
PROD_ONLY, TESTING_ONLY, PROD_PRIOR, TESTING_PRIOR = range(4)
KEYS = ["host", "stage"]
VALUES = ["host_name", "bodies", "noises", "author", "pub_time", "title", "reserved_nodes", "no_semantic_denoise", "need_browser_crawl", "body_use_rule_only"]
#: Pattern rules up to this number are broadcast to the pages (about 1 KB each).
MOST_PATTERNS = 10_000


def matches(url: Column, host: Column) -> Column:
    """A rule applies to urls that start with its host, or that its pattern finds."""
    bare = bare_url(url)
    return F.startswith(bare, host) | (F.rlike(host, F.lit(r"[*+]")) & F.rlike(bare, host))


def valid_rules(rules: DataFrame, group: int = PROD_ONLY) -> DataFrame:
    """The rules in force for a stage group; of two stages the preferred one of a host wins."""
    live = rules.filter(F.col("status") == VALID)
    if group in (PROD_ONLY, TESTING_ONLY):
        return live.filter(F.col("stage") == (PRODUCTION if group == PROD_ONLY else TESTING))
    first = PRODUCTION if group == PROD_PRIOR else TESTING
    own = live.filter(F.col("stage") == first)
    return own.unionByName(live.filter(F.col("stage") != first).join(own.select("host"), "host", "left_anti"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host) of all rules that apply to each distinct url.

    Plain hosts join by equality: a url is cut at every length that a host has
    (a few dozen), instead of being compared with each rule.
    """
    urls = pages.select("url").distinct().withColumn("_bare", bare_url(F.col("url")))
    hosts = rules.select("host").distinct()
    lengths = sorted(r[0] for r in hosts.select(F.length("host")).distinct().collect())  # distinct lengths: a few dozen
    cut = urls.select("url", "_bare", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_n")).filter(F.length("_bare") >= F.col("_n"))
    plain = cut.select("url", F.expr("substring(_bare, 1, _n)").alias("host")).join(hosts, "host").select("url", "host")
    patterns = hosts.filter(F.rlike("host", F.lit(r"[*+]")))
    if patterns.count() <= MOST_PATTERNS:
        patterns = F.broadcast(patterns)
    found = urls.join(patterns, F.rlike("_bare", F.col("host"))).select("url", "host")
    return plain.union(found).distinct()


def pick_rules(pages: DataFrame, rules: DataFrame, group: int = PROD_ONLY) -> DataFrame:
    """The pages, each with the rule of the longest matching host (ties: the larger host)."""
    live = valid_rules(rules, group)
    best = match_rules(pages, live).groupBy("url").agg(F.max_by("host", F.struct(F.octet_length("host"), "host")).alias("_host"))
    live = live.groupBy(F.col("host").alias("_host")).agg(F.max_by(F.struct(*VALUES), F.struct("update_time")).alias("rule"))
    return pages.join(best, "url", "left").join(live, "_host", "left").withColumnRenamed("_host", "rule_host")


def rule_list(rules: DataFrame, search: str = "", order_by: str = "") -> DataFrame:
    """Valid rules whose name or host holds the text, else those that match it as a url;
    hosts with a rule in testing come first, then by host or, newest first, by
    ``-update_time`` or ``-create_time``."""
    live = rules.filter(F.col("status") == VALID)
    if search:
        named = live.filter(F.contains("host_name", F.lit(search)) | F.contains("host", F.lit(search)))
        live = named if named.limit(1).count() else live.filter(matches(F.lit(search), F.col("host")))
    editing = F.max((F.col("stage") == TESTING).cast("int")).over(Window.partitionBy("host"))
    return live.withColumn("editing", editing).orderBy(F.desc("editing"), *([F.desc(order_by[1:])] if order_by in ("-update_time", "-create_time") else []), "host", "stage")


def rule_detail(rules: DataFrame, host: str, stage: int) -> DataFrame:
    return rules.filter((F.col("status") == VALID) & (F.col("host") == host) & (F.col("stage") == stage))


def rule_upsert(rules: DataFrame, changes: DataFrame, now: Column, keep_times: bool = False) -> DataFrame:
    return upsert(rules, changes, KEYS, VALUES, now, keep_times)


def rule_new(rules: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """Testing rules for hosts that have none yet; others are left out."""
    fresh = added.withColumn("stage", F.lit(TESTING)).join(rules.filter((F.col("status") == VALID) & (F.col("stage") == TESTING)).select("host"), "host", "left_anti")
    return rule_upsert(rules, fresh, now)


def rule_to_test(rules: DataFrame, hosts: list[str], now: Column) -> DataFrame:
    """Copy production rules to testing where no testing rule exists."""
    prod = rules.filter((F.col("status") == VALID) & (F.col("stage") == PRODUCTION) & F.col("host").isin(hosts))
    return rule_new(rules, prod.drop("stage"), now)


def rule_publish(rules: DataFrame, hosts: list[str], now: Column) -> DataFrame:
    """Testing rules become production rules and are retired; no hosts means all."""
    chosen = (F.col("status") == VALID) & (F.col("stage") == TESTING) & (F.col("host").isin(hosts) if hosts else F.lit(True))
    out = rule_upsert(rules, rules.filter(chosen).withColumn("stage", F.lit(PRODUCTION)), now)
    return retire(out, chosen, now)


def rule_update(rules: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """New values for testing rules that exist."""
    known = rules.filter((F.col("status") == VALID) & (F.col("stage") == TESTING)).select("host")
    return rule_upsert(rules, changes.withColumn("stage", F.lit(TESTING)).join(known, "host", "left_semi"), now)


def retire(rules: DataFrame, which: Column, now: Column) -> DataFrame:
    return rules.withColumn("update_time", F.when(which, now).otherwise(F.col("update_time"))).withColumn("status", F.when(which, DELETED).otherwise(F.col("status")))


def rule_delete(rules: DataFrame, hosts: list[str], stage: int, now: Column) -> DataFrame:
    gone = (F.col("status") == VALID) & F.col("host").isin(hosts) & (F.col("stage") == stage)
    out = rules.withColumn("_gone", gone)
    return retire(out, F.col("_gone"), now).drop("_gone")


def export_rules(rules: DataFrame) -> DataFrame:
    """Production rules as JSON texts."""
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return valid_rules(rules).select("host", F.to_json(F.struct("host", "host_name", "stage", *VALUES[1:], clock("create_time"), clock("update_time"))).alias("json"))


def import_rules(rules: DataFrame, texts: DataFrame, now: Column) -> DataFrame:
    """Rules from JSON texts, with the times they bring; unreadable times become now."""
    kinds = ", ".join(f for f in RULE.split(", ") if not f.startswith(("create_time", "update_time", "status")))
    read = texts.select(F.from_json("json", f"{kinds}, create_time string, update_time string").alias("r")).select("r.*")
    for c in ("create_time", "update_time"):
        read = read.withColumn(c, F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), now))
    return rule_upsert(rules, read, now, keep_times=True)
