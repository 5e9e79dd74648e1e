"""URL filters (operator 7): pattern rules indexed by their rarest literal token, in DataFrame functions only.

Each rule is a regular expression over host + path + rest of a URL, with the literal tokens that
every match holds. It is filed under the one of them that fewest pages have, counted over all
pages; a rule without a literal token is filed under the empty token, which every URL has. The
tokens of a URL fetch the rules filed under them, and only these run their expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patentkin.operators.skew import broadcast_if_small, cut_lineage

#: Host and path rules: (verdict, host, path).
PLACE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules for URLs that no host and path rule fits: (verdict, regular expression, literal tokens of every match).
#: A rule of several words is one rule for each, so that each has its token. Two look for a part of a token and have none.
PATTERN_RULES = [
    ("block", r"(?:^|\.)ads?\d*\.[^/]*", []),
    ("block", r"[?&]utm_source=ads?(?:&|$)", ["utm", "source"]),
    *[("block", rf"/{word}(?:[/?]|$)", [word]) for word in ("login", "signin", "logout")],
    ("block", r"/cart/checkout(?:[/?]|$)", ["cart", "checkout"]),
    *[("block", rf"\.{end}(?:[?]|$)", [end]) for end in ("exe", "zip", "iso", "apk")],
    ("block", r"^[^/]*casino[^/]*/", []),
]
_TOKEN = "[^a-z0-9]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def place_rule(verdict: str, host: str, path: str) -> tuple[str, str, str, int, list[str]]:
    """(name, verdict, expression, weight, tokens) of a host and path rule, longer ones weighing more.

    The last part of the path may be cut short, so it is a token only if a slash ends it.
    """
    whole = path[: path.rfind("/") + 1]
    tokens = [t for t in re.split(_TOKEN, f"{host}{whole}".lower()) if t]
    return (f"{host}{path}", verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", len(host) + len(path), tokens)


def pattern_rule(verdict: str, pattern: str, tokens: list[str]) -> tuple[str, str, str, int, list[str]]:
    """As place_rule, without a name; it counts only where no named rule fits."""
    return (None, verdict, pattern, 0, tokens)


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(place), _TOKEN)))


def filed_rules(spark: SparkSession, urls: DataFrame, rules: list[tuple]) -> DataFrame:
    """(token, name, verdict, expression, weight): each rule under its rarest token among `urls` (place)."""
    names = ("id", "name", "verdict", "expression", "weight", "tokens")
    kinds = ("int", "string", "string", "string", "int", "array<string>")
    row = lambda r: F.struct(*[F.lit(x).cast(t).alias(c) for x, c, t in zip(r, names, kinds, strict=True)])
    table = spark.range(1).select(F.inline(F.array(*[row((k, *rule)) for k, rule in enumerate(rules)])))
    wanted = table.select("id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    names = broadcast_if_small(wanted.select("token").distinct())
    counts = urls.select(F.explode(_tokens(F.col("place"))).alias("token")).join(names, "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
        .select("id", "r.token")
    )
    return rarest.join(table.drop("tokens"), "id").drop("id")


def judge(pages: DataFrame, places=PLACE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict.

    A host and path rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins. Where none fits, a URL is blocked if a blocking pattern is found in it, and
    allowed otherwise. Null URLs and URLs without `://` have an empty host and path and are
    allowed. Repeated rows have a row each. Other columns are not read.
    """
    url = F.col("url")
    rest = _rest(url)
    place = F.concat(host_of(url), F.coalesce(F.substring(rest, F.char_length(host_of(url)) + 1, F.char_length(rest)), F.lit("")))
    urls = pages.select("url").where("url is not null").select("url", place.alias("place"))
    rules = [place_rule(*r) for r in places] + [pattern_rule(*r) for r in patterns]
    filed = broadcast_if_small(cut_lineage(filed_rules(pages.sparkSession, urls, rules)))
    fetched = urls.select("url", "place", F.explode(_tokens(F.col("place"))).alias("token")).join(filed, "token")
    fits = fetched.where(F.expr("place rlike expression"))
    # the longest named rule, or a blocking pattern
    best = fits.groupBy("url").agg(
        F.max(F.struct("weight", "name", "verdict")).alias("best"),
        F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocked"),
    )
    found = best.select(
        "url", F.col("best.name").alias("rule"),
        F.when(F.col("best.name").isNotNull(), F.col("best.verdict")).when(F.col("blocked") == 1, "block").otherwise("allow").alias("found"),
    )
    # written out, so that the join can be split at frequent URLs
    found = cut_lineage(found)
    return pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).join(found, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict")
    )
