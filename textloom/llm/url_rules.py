"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host + path: `||` anchors at a host label, `*` stands for anything, `^`
for one character outside a-z, 0-9 or the end, other characters for themselves. Runs of a-z and
0-9 that cannot continue on either side are the rule's literal tokens: any URL that the rule fits
contains each of them as a token. Rules are filed under the literal that is rarest in the corpus;
a URL's own tokens fetch candidates, and only those run their regular expression.

Two kinds of rules: host rules (`example.com/en/`), of which the longest that fits decides, and
method rules, which decide where no host rule fits (an exception rule outweighs a block rule).

Defined results: null URL or one without `://` has empty host and path, no rule, and the method's
verdict on an empty target (allow); repeated rows give repeated rows; only key and url are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

ALLOW, BLOCK = "allow", "block"

# The host rules of the contract.
HOST_RULES = [
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
]

#: Method rules: unwanted kinds of sites, by words of their host labels or of their path.
METHOD_RULES = [
    *((BLOCK, f"^{word}^") for word in ("adult", "porn", "xxx", "casino", "bets", "poker", "pills", "viagra", "spam", "adserver", "doubleclick")),
    (BLOCK, "||ads-track."),
    (BLOCK, "||ads.*/"),
    (BLOCK, "^free-bets^"),
    (BLOCK, "^link-farm^"),
    (ALLOW, "||spam-research.*/"),
]

PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
TOKEN = re.compile(r"[a-z0-9]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    pattern: str
    is_host_rule: bool
    only: tuple[str, ...] = ()  # the rule counts on these domains alone
    never: tuple[str, ...] = ()  # and on none of these
    regex: str = field(init=False)
    literals: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        anchored = self.pattern.startswith("|")
        start = r"^(?:[^/]*[.])?" if self.pattern.startswith("||") else "^" if anchored else ""
        body = self.pattern.lstrip("|")
        end = "$" if body.endswith("|") else ""
        body = body.removesuffix("|")
        outside = "(?:^|[^a-z0-9]|$)"
        object.__setattr__(self, "regex", start + "".join({"*": ".*", "^": outside}.get(c, re.escape(c)) for c in body) + end)
        found = []
        for m in TOKEN.finditer(body.lower()):
            left = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
            right = body[m.end()] if m.end() < len(body) else end or "*"
            if left != "*" and right != "*":
                found.append(m[0])
        object.__setattr__(self, "literals", tuple(found))


def host_rule(verdict: str, rule: str) -> Rule:
    return Rule(verdict, rule, f"||{rule}", True)


def method_rule(verdict: str, pattern: str) -> Rule:
    return Rule(verdict, pattern, pattern, False)


def parse(lines: Iterable[str]) -> list[Rule]:
    """Rules in the common filter-list syntax, one a line.

    `||` anchors at a host label, `|` at the start or the end of host + path, `*` and `^` as in patterns;
    `@@` makes an exception; `$domain=a.com|~b.com` names the hosts on which a rule counts. Empty lines,
    comments (`!`, `[`), element rules (`##`) and rules with other options are passed over.
    """
    found = []
    for line in map(str.strip, lines):
        if not line or line[0] in "![" or "##" in line or "#@#" in line:
            continue
        verdict, text = (ALLOW, line[2:]) if line.startswith("@@") else (BLOCK, line)
        pattern, _, options = text.partition("$")
        named = [o.removeprefix("domain=") for o in options.split(",") if o.startswith("domain=")]
        if len(named) != len([o for o in options.split(",") if o]) or not pattern.strip("|*^"):
            continue
        domains = [d.lower() for n in named for d in n.split("|") if d]
        pattern = re.sub(r"^(\|?)https?://", r"\1", pattern)
        found.append(Rule(verdict, line, pattern, False, tuple(d for d in domains if d[0] != "~"), tuple(d[1:] for d in domains if d[0] == "~")))
    return found


def within(host: str, domains: tuple[str, ...]) -> bool:
    return any(host == d or host.endswith(f".{d}") for d in domains)


def split_url(url: str | None) -> tuple[str, str]:
    m = PARTS.search(url) if url else None
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def token_counts(df: DataFrame, url: str, wanted: Iterable[str]) -> dict[str, int]:
    """How many URLs contain each wanted token. The result has a row for each wanted token at most."""
    wanted = sorted(set(wanted))
    if not wanted:
        return {}
    held = F.array_intersect(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    return {r["token"]: r["count"] for r in df.select(F.explode(held).alias("token")).groupBy("token").count().collect()}


class RuleIndex:
    """Rules filed under their rarest literal token; rules without one are candidates for every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex, re.S if rule.is_host_rule else re.S | re.I))
            if rule.literals:
                rarest = min(rule.literals, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, target: str) -> list:
        """The rules to try on host + path: those filed under one of its tokens, and those without a literal."""
        found = list(self.always)
        for token in set(TOKEN.findall(target.translate(UPPER))):
            found += self.by_token.get(token, ())
        return found

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        target = host + path
        best: Rule | None = None
        method = ""
        for rule, regex in self.candidates(target):
            if rule.only and not within(host, rule.only) or within(host, rule.never) or not regex.search(target):
                continue
            if not rule.is_host_rule:
                method = ALLOW if ALLOW in (method, rule.verdict) else BLOCK
            elif best is None or len(rule.name) > len(best.name):
                best = rule
        return (best.name, best.verdict) if best else (None, method or ALLOW)


def judge(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row. The rules are a parameter, so shipping their index is bounded by it."""
    df = df.select(key, url)
    index = RuleIndex(rules, token_counts(df, url, (t for r in rules for t in r.literals)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(url).to_pylist()]
            said = [index.judge(*p) for p in parts]
            columns = [pa.array([x[i] for x in rows], pa.string()) for rows in (parts, said) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "host", "path", "rule", "verdict"])

    return arrow_map(df, run, f"{key} {df.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")


RULES = [*(host_rule(*r) for r in HOST_RULES), *(method_rule(*r) for r in METHOD_RULES)]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def _oracle() -> str:
    def fits(r: Rule) -> str:
        return f"regexp_matches(target, '{r.regex}', '{'s' if r.is_host_rule else 'si'}')"

    longest = sorted((r for r in RULES if r.is_host_rule), key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest)
    method = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in sorted((r for r in RULES if not r.is_host_rule), key=lambda r: r.verdict))
    host = r"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1)"
    return f"""WITH p AS (SELECT page_id, {host} AS host, {path} AS path FROM pages), t AS (SELECT *, host || path AS target FROM p)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} {method} ELSE 'allow' END AS verdict FROM t"""


ORACLE = _oracle()
