"""URL rules fetched by token, with DataFrame functions alone.

A rule is a regular expression over `host + path` with the literal tokens that any match must contain. Each rule is filed
under the one of its tokens that the fewest URLs contain; a URL's tokens fetch the rules filed under them, and only those
are run. Rules without a literal token are run on every URL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small

#: Site rules in the order in which they are given: (verdict, rule).
SITE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Host labels of unwanted sites, used where no site rule fits.
BAD_LABELS = ["spam-farm", "casino-win", "cheap-pills", "free-bets", "adult-x", "ads-track"]
MOST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ? or #. Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, "[^0-9A-Za-z]+")), "")


def site_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, int, int]]:
    """(rule, verdict, pattern, tier, rank) of rules `host/path`: host or a subdomain of it, path from its start. Among these the longest wins."""
    return [(rule, verdict, r"^(?:[^/]*\.)?" + re.escape(rule).replace(r"\-", "-"), 1, len(rule)) for verdict, rule in rules]


def label_rules(labels: list[str]) -> list[tuple[str, str, str, int, int]]:
    """Rules that block hosts which have one of these labels."""
    return [(label, "block", r"^(?:[^/]*\.)?" + re.escape(label).replace(r"\-", "-") + r"(?:\.[^/]*)?(?:/|$)", 0, len(label)) for label in labels]


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str, int, int]]) -> DataFrame:
    """Rules as rows, with their literal tokens. A site rule's or label's own text is literal throughout, but for its last token, which may go on in a path."""
    rows = []
    for rule, verdict, pattern, tier, rank in rules:
        tokens = [x for x in re.split("[^0-9A-Za-z]+", rule) if x]
        if tier == 1 and not rule.endswith("/") and "/" in rule:
            tokens = tokens[:-1]
        rows.append((rule, verdict, pattern, tier, rank, tokens))
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, tier int, rank int, tokens array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, ...).

    Of the rules whose patterns are found in host + path the highest tier decides, in it the highest rank, then the rule
    that is last by text. rule names it if it is a site rule (tier 1), else it is null; without any, the verdict is
    `default`. A null url, or one without ://, has an empty host and path. Each row is judged by itself, so repeated rows
    and page ids, also null, give repeated results. URLs of any length are judged whole. Extra columns, whatever their names, are not read. An empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    seen = urls.select("host", "path").groupBy("host", "path").count()
    seen = materialize(seen.select("host", "path", "count", F.concat("host", "path").alias("site")))
    tokens = seen.select("host", "path", "site", "count", F.explode(_tokens(F.col("site"))).alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    common = tokens.join(small(wanted, MOST_RULES), "token").groupBy("token").agg(F.sum("count").alias("urls"))
    filed = rules.select("*", F.explode_outer("tokens").alias("token")).join(common, "token", "left")
    filed = filed.groupBy("rule", "verdict", "pattern", "tier", "rank").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    filed = materialize(filed)
    best = F.max(F.struct("tier", "rank", "rule", "verdict")).alias("best")
    fetched = tokens.join(small(filed.where("token is not null"), MOST_RULES), "token")
    always = filed.where("token is null")
    if always.limit(1).count():
        # Rules without a token meet every distinct URL: a stated query set, broadcast while it is small.
        fetched = fetched.select("host", "path", "site", "tier", "rank", "rule", "verdict", "pattern").unionAll(
            seen.crossJoin(small(always.drop("token"), MOST_RULES)).select("host", "path", "site", "tier", "rank", "rule", "verdict", "pattern")
        )
    hit = fetched.where(F.expr("site rlike pattern")).groupBy("host", "path").agg(best)
    out = urls.join(hit, ["host", "path"], "left")
    return out.select(
        "page_id", "host", "path", F.when(F.col("best.tier") == 1, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
