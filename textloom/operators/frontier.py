"""URL frontier: insert-or-ignore, claims, states, an offline schedule, a stop at a byte target, enqueued links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.shared import first_per, numbered

PENDING, INFLIGHT, DONE, FAILED, SKIPPED = range(5)
MIN_HITS, MIN_CHARS = 3, 500
MAX_DEPTH, MAX_LINKS = 6, 300
CLAIM = 200
DELAY, CONCURRENCY = 1.5, 2


def insert_or_ignore(frontier: DataFrame, rows: DataFrame, order: str = "discovered") -> DataFrame:
    """New rows only: the first of each URL, unless the frontier has it."""
    return first_per(rows, ["url"], order).join(frontier.select("url"), "url", "left_anti")


def claim(frontier: DataFrame, per_host: int = CLAIM) -> DataFrame:
    """Up to `per_host` pending URLs of each host by priority, then URL, marked as in flight."""
    order = Window.partitionBy("host").orderBy(F.desc("priority"), "url")
    picked = frontier.filter(F.col("status") == PENDING).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_host).drop("_n")
    return picked.withColumn("status", F.lit(INFLIGHT))


def finish(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """The frontier with the states of `done` (url, new_status)."""
    return frontier.join(done, "url", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def requeue(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("status", F.when(F.col("status") == INFLIGHT, F.lit(PENDING)).otherwise(F.col("status")))


def schedule(frontier: DataFrame, delay: float = DELAY, ties: str = "discovered") -> DataFrame:
    """The offline plan of a polite scheduler: starts on a host are `delay` apart, the best first, then by URL, the earlier of equal ones."""
    order = Window.partitionBy("host").orderBy(F.desc("priority"), "url", ties)
    return frontier.withColumn("start", (F.row_number().over(order) - 1) * F.lit(delay))


def stop_at(log: DataFrame, target: int, order: list[str], size: str = "bytes") -> DataFrame:
    """The first row at which the running total reaches the target (none if it never does)."""
    return numbered(log, order, "total", size).filter(F.col("total") >= target).orderBy(*order).limit(1)


def relevance(hits, chars, depth):
    """(stored, expands): on topic and long enough; hubs up to depth 1 are expanded anyway."""
    on_topic = hits >= MIN_HITS
    return on_topic & (chars >= MIN_CHARS), on_topic | (depth <= 1)


def enqueue(pages: DataFrame, allowed: list[str], year: int, base: str = "url", page: str = "page_id", depth: str = "depth", source: str = "html", max_depth: int = MAX_DEPTH, most: int = MAX_LINKS) -> DataFrame:
    """(page, url, host, depth, priority) of the links that pages add to the frontier."""
    found = pages.filter(F.col(depth) < max_depth).select(page, depth, F.col(base).alias("_base"), F.posexplode(F.slice(html.links(F.col(source)), 1, most)).alias("_pos", "_href"))
    child = F.col(depth) + 1
    url = urls.canonical(urls.resolve(F.col("_base"), F.col("_href")))
    rows = found.select(page, child.alias("depth"), url.alias("url")).filter(F.col("url").isNotNull()).filter(urls.crawlable(F.col("url"), allowed)).dropDuplicates([page, "url"])
    return rows.select(page, "url", urls.host_of(F.col("url")).alias("host"), "depth", urls.priority(F.col("url"), F.col("depth"), year).alias("priority"))


def robots(rows: DataFrame, rules: DataFrame, delay: float = DELAY) -> DataFrame:
    """rows (url) against rules (origin, disallow, crawl_delay): allowed, and the delay to keep."""
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    path = F.when(urls.path_of(F.col("url")) == "", F.lit("/")).otherwise(urls.path_of(F.col("url")))
    placed = rows.withColumn("origin", origin).withColumn("_path", path).join(rules, "origin", "left")
    denied = F.coalesce((F.col("disallow") != "") & F.col("_path").startswith(F.col("disallow")), F.lit(False))
    return placed.groupBy("url").agg((~F.bool_or(denied)).alias("allowed"), F.greatest(F.lit(delay), F.coalesce(F.max("crawl_delay"), F.lit(0.0))).alias("delay"))
