"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` and the literal tokens that every match must contain. Each
rule is filed under that of its tokens which is rarest in the corpus' URLs (counted over all of them). A URL's
tokens fetch candidate rules from the index, and only those run their expressions; every rule has a literal.

A list of up to INLINE_RULES rules goes along in the plan, and everything stays inside the row: no shuffle but for the
token counts, which combine to one row per indexed token. A longer list is a table: distinct URLs are joined with it on
the token, which the rarest literals keep short.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

INLINE_RULES = 1000  #: rules that the plan holds as one literal
BROADCAST_RULES = 100_000  #: rows of rules (some 200 bytes each) that may be broadcast


@dataclass(frozen=True)
class Rule:
    """tier: the lowest tier with a match decides; in it the longest name, then the smaller name."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    tier: int = 1


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the URL's path starts with the rule's."""
    host, _, path = name.partition("/")
    pattern = rf"^([^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    return Rule(name, verdict, pattern, tuple(re.findall("[a-z0-9]+", host)), 0)


HOST_RULES = [
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
]


def word_rule(word: str) -> Rule:
    """A word or hyphenated words as whole tokens anywhere in the host."""
    tokens = tuple(re.findall("[a-z0-9]+", word))
    return Rule(f"~{word}", "block", rf"^[^/]*\b{re.escape(word)}\b", tokens)


#: The method's own rules for URLs that no host rule fits.
METHOD_RULES = [
    *(word_rule(w) for w in ("casino", "casino-win", "cheap-pills", "free-bets", "ads-track", "poker", "jackpot", "viagra", "payday", "adserver", "doubleclick", "torrent", "warez", "escort", "xxx")),
    *(Rule(f"~/{t}/", "block", rf"/{t}(/|$)", (t,)) for t in ("ad", "ads")),
    *(Rule(f"~.{t}", "block", rf"\.{t}$", (t,)) for t in ("exe", "msi", "apk", "dmg")),
    *(Rule(f"~/{t}", "block", rf"/{t}\b", (t,)) for t in ("login", "signin", "logout")),
]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit("[a-z0-9]+"), F.lit(0)))


def rarest_literals(urls: DataFrame, rules: list[Rule]) -> dict[str, str]:
    """Of each rule's literals, the one in the fewest URLs; urls has host and path."""
    wanted = sorted({t for r in rules for t in r.literals})
    tokens = _tokens(F.concat("host", "path"))
    if len(wanted) <= INLINE_RULES:
        held = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        listed = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        held = urls.select(F.explode(tokens).alias("token")).join(broadcast_if_small(listed, BROADCAST_RULES), "token")
    seen = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # one row per literal of the rules at most
    return {r.name: min(r.literals, key=lambda t: (seen.get(t, 0), t)) for r in rules}


def _best_inline(urls: DataFrame, rules: list[Rule], filed: dict[str, str]) -> DataFrame:
    as_struct = lambda r: F.struct(F.lit(r.tier).alias("tier"), F.lit(-len(r.name)).alias("short"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    index = {}
    for r in rules:
        index.setdefault(filed[r.name], []).append(as_struct(r))
    if not index:
        return urls.withColumn("best", F.lit(None).cast(_BEST))
    table = F.create_map(*(x for token, held in index.items() for x in (F.lit(token), F.array(*held))))
    subject = F.concat("host", "path")
    indexed = F.array_intersect(_tokens(subject), F.array(*map(F.lit, index)))
    candidates = F.flatten(F.transform(indexed, lambda t: F.element_at(table, t)))
    return urls.withColumn("best", F.array_min(F.filter(candidates, lambda r: F.rlike(subject, r["pattern"]))))


_BEST = "struct<tier: int, short: int, name: string, verdict: string, pattern: string>"


def _best_joined(urls: DataFrame, rules: list[Rule], filed: dict[str, str]) -> DataFrame:
    listed = [(filed[r.name], r.tier, -len(r.name), r.name, r.verdict, r.pattern) for r in rules]
    table = urls.sparkSession.createDataFrame(listed, f"token string, {_BEST[7:-1]}".replace(": ", " "))
    subject = F.concat("host", "path")
    seen = urls.select(subject.alias("subject")).distinct()
    pairs = seen.select("subject", F.explode(_tokens(F.col("subject"))).alias("token")).join(broadcast_if_small(table, BROADCAST_RULES), "token")
    fits = pairs.filter(F.rlike("subject", F.col("pattern")))
    best = fits.groupBy("subject").agg(F.min(F.struct("tier", "short", "name", "verdict", "pattern")).alias("best"))
    return urls.join(best, subject == F.col("subject"), "left")


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, tier, verdict.

    Reads ``page_id`` and ``url`` only. A null url, or one without ``://``, has an empty host and path and gets the
    default verdict. URLs of any length are judged whole. Repeated rows are judged alike; an empty table gives none.
    Rules need different names, and literals that every match of theirs contains as whole runs of [a-z0-9].
    """
    if len({r.name for r in rules}) < len(rules) or not all(r.literals for r in rules):
        raise ValueError("rules need different names and a literal each")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = _best_inline if len(rules) <= INLINE_RULES else _best_joined
    return best(urls, rules, rarest_literals(urls, rules)).select(
        "page_id",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.col("best.tier").alias("tier"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
