"""Collection cleaning: rule parser, disjunctive keep rule, topic filter, sampling, and their order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import read_lines
from ..plans.shared import numbered

#: Rule keys: hosts, regular expressions on URL or title, and titles that count from a number of topic hits.
KEYS = ("host", "url", "title", "title_hits", "title_hits_except_host")


@dataclass
class Rules:
    hosts: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    hit_titles: list[str] = field(default_factory=list)
    min_hits: int = 0
    except_hosts: list[str] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> "Rules":
        """`key = value` lines; title_hits is `least :: regex`; an unknown key is an error."""
        rules = Rules()
        lists = {"host": rules.hosts, "url": rules.urls, "title": rules.titles, "title_hits_except_host": rules.except_hosts}
        for line in read_lines(text):
            key, _, value = (x.strip() for x in line.partition("="))
            if key == "title_hits":
                least, _, pattern = (x.strip() for x in value.partition("::"))
                rules.min_hits = int(least)
                rules.hit_titles.append(pattern)
            elif key in lists:
                lists[key].append(value)
            else:
                raise ValueError(f"unknown rule {key!r}")
        return rules

    def rows(self) -> list[tuple[str, str, int]]:
        classes = (("host", self.hosts), ("url", self.urls), ("title", self.titles), ("title_hits", self.hit_titles), ("title_hits_except_host", self.except_hosts))
        return [(name, x, self.min_hits if name == "title_hits" else 0) for name, values in classes for x in values]


def any_of(column: Column, patterns: list[str]) -> Column:
    """Case-insensitive search for any pattern; a class of rules becomes one expression."""
    return F.coalesce(column, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def keep_rule(rules: Rules, host: Column, url: Column, title: Column, hits: Column) -> Column:
    by_hits = F.lit(False)
    if rules.hit_titles:
        by_hits = ~F.coalesce(host, F.lit("")).isin(rules.except_hosts) & (F.coalesce(hits, F.lit(0)) >= rules.min_hits) & any_of(title, rules.hit_titles)
    by_host = F.coalesce(host, F.lit("")).isin(rules.hosts) if rules.hosts else F.lit(False)
    return by_host | any_of(url, rules.urls) | any_of(title, rules.titles) | by_hits


def clean(docs: DataFrame, meta: DataFrame, rules: Rules, key: str = "doc_id") -> DataFrame:
    """Documents whose metadata passes; metadata is filtered before any text is read."""
    return docs.join(meta.filter(keep_rule(rules, F.col("host"), F.col("url"), F.col("title"), F.col("hits"))).select(key), key, "left_semi")


def on_topic(docs: DataFrame, meta: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """Documents with enough topic hits; missing metadata counts as none."""
    return docs.join(meta.select(key, "hits"), key, "left").filter(F.coalesce("hits", F.lit(0)) >= least).drop("hits")


def sample(docs: DataFrame, order: list[str], limit: int) -> DataFrame:
    """`limit` rows at equal distances in the order: positions floor(i·n/limit). All rows if there are no more."""
    n = docs.count()
    placed = numbered(docs, order, "position")
    if not 0 < limit < n:
        return placed
    wanted = docs.sparkSession.range(limit).select(F.floor(F.col("id") * F.lit(n).cast("double") / F.lit(limit).cast("double")).alias("position"))
    return placed.join(F.broadcast(wanted) if limit <= 1_000_000 else wanted, "position", "left_semi")
