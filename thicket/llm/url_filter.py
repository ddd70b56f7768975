"""URL filters: rules are indexed by their rarest literal token, and only rules that a URL's tokens fetch are run.

A rule is a host rule, like example.net/en/ (the host with its subdomains, and the beginning of the path), or a pattern,
where ^ stands for a character that isn't a letter or digit or for an end, * for anything, and || at the front for the
beginning of any label of the host. Its literal tokens are the runs of letters and digits that a matching URL must hold
as whole tokens; the index takes the one that the fewest URLs hold. Rules without a literal token are tried on all URLs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import LOWER, UPPER, ascii_lower, broadcast_if, unused

#: Rules that are broadcast at most; beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What the method blocks if no host rule fits: hosts with a label that begins like an advert, a lure or adult content.
PATTERNS = [("block", "||ads-"), ("block", "||adult-"), ("block", "||casino-"), ("block", "||cheap-"), ("block", "||free-"), ("block", "||spam-"), ("block", "||tracker-"), ("block", "||porn-"), ("block", "||ads."), ("block", "||adserver.")]
_ASCII = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, over host and path as one string."""
    body, front = (pattern[2:], r"^(?:[^/]*\.)?") if pattern.startswith("||") else (pattern, "")
    edge = r"(?:^|$|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    return front + "".join(r"(?s:.*)" if c == "*" else edge if c == "^" else re.escape(c) for c in body)


def pattern_tokens(pattern: str) -> list[str]:
    """Runs that are whole tokens in whatever matches: between separators, or after || and before a separator."""
    found = []
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", pattern):
        before, after = pattern[: m.start()], pattern[m.end() :]
        if before and before[-1] != "*" and after and after[0] != "*":
            found.append(m[0].translate(_ASCII))
    return found


def host_rule(rule: str) -> tuple[str, str, list[str]]:
    """(host, path, tokens) of a host rule. The last run of the path counts only if the rule goes on after it."""
    host, slash, rest = rule.partition("/")
    host, path = host.translate(_ASCII), slash + rest
    tokens = [t for t in re.split(SEPARATORS, host) if t]
    inner = re.split(SEPARATORS, path.translate(_ASCII))
    return host, path, tokens + [t for t in inner[:-1] if t]


def rule_table(spark, host_rules: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """(rule, action, host, path, regex, tokens) for (action, rule) pairs; host is null for patterns."""
    rows = [(r, a, *host_rule(r)[:2], None, host_rule(r)[2]) for a, r in host_rules] + [(r, a, None, None, pattern_regex(r), pattern_tokens(r)) for a, r in patterns]
    return spark.createDataFrame(rows, "rule string, action string, host string, path string, regex string, tokens array<string>").dropDuplicates(["rule", "host"])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest host rule that fits; else null), pattern (the first pattern that matches;
    else null) and verdict (the rule's action, else the pattern's, else default).

    Null urls and urls without :// have an empty host and path, and fit no rule. Repeated rows get the same verdict;
    columns of pages with those names are replaced. Rules of one length go by their text.
    """
    base = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")])
    own = unused("url", base.columns)
    judged = unused("judged", [*base.columns, own])
    keyed = base.withColumn(own, F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    urls = keyed.select(F.col(own).alias("u")).distinct().select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path"))
    tokens = F.array_distinct(F.split(ascii_lower(F.concat_ws("/", "host", "path")), SEPARATORS))
    n_rules = rules.count()
    literal = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode(tokens).alias("token")).join(broadcast_if(literal, n_rules, BROADCAST_ROWS // 10), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # The rarest token of each rule; a token that no URL has is the rarest of all. No token at all: the empty one, which every URL is given.
    spread = rules.select("rule", F.col("host").alias("rh"), F.col("path").alias("rp"), "action", "regex", F.explode_outer("tokens").alias("token"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("*")))
    best = spread.join(counts, "token", "left").groupBy("rule", "rh", "rp", "action", "regex").agg(F.min_by(F.coalesce("token", F.lit("*")), rarity).alias("token"))
    fetched = urls.select("u", "host", "path", "target", F.explode(F.array_union(tokens, F.array(F.lit("*")))).alias("token"))
    fetched = fetched.join(broadcast_if(best, n_rules, BROADCAST_ROWS), "token")
    below = F.endswith(F.col("host"), F.concat(F.lit("."), "rh"))
    fits = F.col("rh").isNotNull() & ((F.col("host") == F.col("rh")) | below) & F.startswith(F.col("path"), F.col("rp"))
    matches = F.col("regex").isNotNull() & F.expr("target rlike regex")
    order = F.struct((-F.length("rule")).alias("l"), F.col("rule").alias("rule"), F.col("action").alias("action"))
    found = fetched.where((F.col("host") != "") & (fits | matches)).groupBy("u").agg(
        F.min(F.when(F.col("rh").isNotNull(), order)).alias("r"), F.min(F.when(F.col("rh").isNull(), F.struct("rule", "action"))).alias("p")
    )
    # Pages are joined by their url: one that very many pages have is split by Spark, as it has one row on the other side.
    out = keyed.join(found.select(F.col("u").alias(own), F.struct("r", "p").alias(judged)), own, "left")
    verdict = F.coalesce(f"{judged}.r.action", f"{judged}.p.action", F.lit(default))
    return out.select(
        *base.columns, host_of(F.col(own)).alias("host"), path_of(F.col(own)).alias("path"),
        F.col(f"{judged}.r.rule").alias("rule"), F.col(f"{judged}.p.rule").alias("pattern"), verdict.alias("verdict"),
    )
