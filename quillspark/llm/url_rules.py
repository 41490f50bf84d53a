"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the normalised url (lower-cased host + path + rest) with an action and a rank.
Each rule is filed under one of its literal tokens, the one that the fewest urls hold. The tokens of a url fetch
candidate rules; only those run their regular expression. Everything is DataFrame operations.

Defined results: a null url, an empty one and one without "://" have empty host and path, no rule and verdict "allow".
Repeated rows are judged each; a null page_id stays; other columns of the table are ignored. An empty table gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, stored, table

#: Host rules of the query: (action, host, path).
SITE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of advertising, gambling, tracking, spam, adult and pharmacy sites; a pattern needs all words of an entry as
#: whole tokens of the url, in this order, next to each other.
BLOCKED_PHRASES = ["casino win", "free bets", "ads track", "spam farm", "cheap pills", "adult x", "online casino", "sports betting", "free spins", "payday loan", "ad server", "ad click", "click track", "link farm", "viagra", "porn", "xxx", "escort", "doubleclick", "adserver"]
#: Up to so many rules their index is broadcast; beyond, it is shuffled.
MAX_RULES = 100_000
#: Words of letters and digits of ASCII in lower case; all else is a boundary, as in the rules' expressions and the SQL.
TOKEN = "[a-z0-9]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """regex runs over "host#/path?rest" (see `address`); tokens are literal words that each matching url holds."""

    name: str
    action: str
    rank: int
    regex: str
    tokens: tuple[str, ...]


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with `path`; a longer rule has a higher rank.

    A token of the path is used only where the rule's path ends it, since a longer word may go on there.
    """
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.translate(LOWER))
    return Rule(host + path, action, 1000 + len(host + path), rf"^([^#]*\.)?{re.escape(host)}#{re.escape(path)}", tuple(re.findall(TOKEN, host) + whole))


def phrase_rule(phrase: str, action: str = "block") -> Rule:
    words = phrase.split()
    return Rule(phrase, action, len(phrase), r"(?i)(?<![a-z0-9])" + "[^a-z0-9]".join(map(re.escape, words)) + r"(?![a-z0-9])", tuple(re.findall(TOKEN, phrase.translate(LOWER))))


def default_rules() -> list[Rule]:
    return [*(site_rule(*r) for r in SITE_RULES), *(phrase_rule(p) for p in BLOCKED_PHRASES)]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What rules see: host, "#" (which no host has), then path and the rest as written; empty for a url without "://"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host_of(url), F.lit("#"), rest)).otherwise("")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, url, host, path, rule (name of the best-ranked rule that matches, else null) and verdict.

    Work follows the distinct urls: copies of a hot url are judged once, and urls without "://" not at all. Up to
    MAX_RULES rules are broadcast, more are shuffled by token; urls join them on tokens, and only the pairs found run a
    regular expression. Verdicts go back to the pages by a join in which a hot url goes to all tasks.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    told = lambda p, rule, action: p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce(action, F.lit(default)).alias("verdict"))
    nothing = F.lit(None).cast("string")
    if not rules:
        return told(pages, nothing, nothing)
    few = F.broadcast if len(rules) <= MAX_RULES else lambda x: x
    listed = spark.createDataFrame([(i, r.name, r.action, r.rank, r.regex, list(r.tokens)) for i, r in enumerate(rules)], "no int, rule string, action string, rank int, regex string, tokens array<string>").coalesce(1)
    proper = F.coalesce(F.col("url").contains("://"), F.lit(False))
    urls = pages.where(proper).groupBy("url").agg(F.count("*").alias("copies")).withColumn("address", address(F.col("url")))
    words = urls.select("url", "address", "copies", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(ascii_lower(F.col("address")), F.lit(f"({TOKEN})"), F.lit(1))))).alias("token"))
    literals = listed.select(F.explode("tokens").alias("token")).distinct()
    frequency = words.join(few(literals), "token").groupBy("token").agg(F.count("*").alias("n"))
    # the rarest token of each rule; a rule without a literal is filed under "", which every url has
    index = (
        listed.select("no", "rule", "action", "rank", "regex", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
        .join(few(frequency), "token", "left")
        .groupBy("no", "rule", "action", "rank", "regex")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    best = (
        words.join(few(index), "token")
        .where(F.expr("address rlike regex"))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "action"), F.struct("rank", -F.col("no"))).alias("hit"), F.max("copies").alias("copies"))
    )
    judged = joined(pages.where(proper), stored(best, lasting=True), ["url"], "copies")
    return told(judged, F.col("hit.rule"), F.col("hit.action")).unionByName(told(pages.where(~proper), nothing, nothing))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged; `rule` names site rules only, `pattern` any rule."""
    out = filter_urls(table(spark, sf_dir, "pages"), default_rules())
    site = F.col("rule").contains("/")
    return out.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.col("rule").alias("pattern"))


def _sql() -> str:
    address = "CASE WHEN contains(coalesce(url, ''), '://') THEN host || '#' || regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1) ELSE '' END"
    site = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2])))
    act = " ".join(f"WHEN pattern = '{h}{p}' THEN '{a}'" for a, h, p in SITE_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    phrases = " ".join(f"WHEN regexp_matches(translate(address, '{upper}', '{lower}'), '(^|[^a-z0-9])" + "[^a-z0-9]".join(p.split()) + f"([^a-z0-9]|$)') THEN '{p}'" for p in sorted(BLOCKED_PHRASES, key=lambda p: (-len(p), BLOCKED_PHRASES.index(p))))
    return f"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
a AS (SELECT *, {address} AS address FROM u),
r AS (SELECT *, CASE {site} {phrases} END AS pattern FROM a)
SELECT page_id, host, path, CASE WHEN contains(pattern, '/') THEN pattern END AS rule,
       CASE WHEN pattern IS NULL THEN 'allow' {act} ELSE 'block' END AS verdict, pattern FROM r"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _sql()}
