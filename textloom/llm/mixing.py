"""Mixing sources to target weights by weighted fair queueing.

Sources weigh 3, 1, 2, 3, … in code-point order (null last) and share a budget of words. A target
above twice its source's size stops there and its excess is shared again by weight. Each source
queues its documents in a hashed order, twice over (a second pass repeats them). A queued document's
virtual time is the source's cumulative words up to the document's middle, divided by the source's
target weight; the queue of all sources is sorted by virtual time and cut where the budget is used
up. Taking the middle of a document rounds each source to half a document instead of a whole one.

Nothing is ordered in one task: cumulative words are prefix sums over 4,096 hash ranges of each
source, and the global cut is found over ranges of virtual time, exactly within the range it falls in.

The order of sources is made in one task of one row a source: sources are labels, and their list is
expected to fit a task (some millions); documents are never ordered so.

Defined results: null text has size 0 and is taken 0 times in words; a source without words has
target 0; rows with equal keys and texts are queued as separate rows; only key, source and text are
read, and what `keep` names is carried along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
TIME_RANGES = 4096  # of one unit of virtual time; the queue ends within [0, 2 * size / target]


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, src, spot, bin, *keep): sizes in words; src has no nulls and sorts nulls last; spot orders the queue.

    The spot is a hash of key and text, so rows of one key (or of none) spread over all bins too.
    """
    spot = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))))
    return (
        docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), spot.alias("spot"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
        .withColumn("src", F.when(F.col("_source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "_source")))
        .withColumn("bin", F.substring("spot", 1, 3))
    )


def targets(rows: DataFrame) -> DataFrame:
    """(src, source_size, target), one row a source.

    Filling by weight with caps has a closed form. Sorted by cap per weight, the level that remains
    when the first k sources are capped grows as long as the next source's cap is under it and falls
    from there on, so the final level is the greatest one.
    """
    every = Window.partitionBy()
    ranked = (
        rows.groupBy("src")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy("src")) - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * MOST)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    below = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    return ranked.withColumn("level", level).select("src", "source_size", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")).alias("target"))


def queue(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with source_size, target, and `v1`, `v2`: virtual times of the first and the second pass."""
    bins = rows.groupBy("src", "bin").agg(F.sum("size").alias("n"))
    before = bins.select("src", "bin", (F.sum("n").over(Window.partitionBy("src").orderBy("bin")) - F.col("n")).alias("before"))
    before = before.join(goals, "src")
    inside = Window.partitionBy("src", "bin").orderBy("spot", "_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum("size").over(inside)).join(before.hint("shuffle_merge"), ["src", "bin"])
    twice = 2 * (F.col("end") + F.col("before")) - F.col("size")
    return ends.withColumn("v1", F.try_divide(twice, 2 * F.col("target"))).withColumn("v2", F.try_divide(twice + 2 * F.col("source_size"), 2 * F.col("target")))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = (), space: Workspace | None = None) -> DataFrame:
    """(key, source, size, source_size, target, passes, *keep): passes says how often a document is taken, 0 to 2."""
    space = space or Workspace(docs.sparkSession, "mixing")
    rows = space.write(sized(docs, key, source, text, keep), "sized")
    queued = space.write(queue(rows, targets(rows)).select("_key", "_source", "src", "spot", "size", "source_size", "target", "v1", "v2", *(f"_keep_{c}" for c in keep)), "queued")
    space.drop("sized")

    def out(passes) -> DataFrame:
        return queued.select(F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", passes.alias("passes"), *(F.col(f"_keep_{c}").alias(c) for c in keep if c not in (key, source)))

    entry = queued.filter("size > 0").select("_key", "src", "spot", "size", F.posexplode(F.array("v1", "v2")).alias("pass", "v")).withColumn("range", F.floor(F.col("v") * TIME_RANGES))
    # Targets, one a source, are summed in the order of sources: in another order the sum could differ in its last bit.
    goals = queued.groupBy("src").agg(F.first("target").alias("t")).agg(F.array_sort(F.collect_list(F.struct("src", "t"))).alias("all"))
    budget = goals.select(F.aggregate("all", F.lit(0.0), lambda total, x: total + x["t"])).first()[0]
    # The range in which the budget runs out, then the place within it.
    ranges = entry.groupBy("range").agg(F.sum("size").alias("n"))
    running = ranges.select("range", "n", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    cut = running.filter((F.col("before") <= budget) & (F.col("before") + F.col("n") > budget)).first()
    if cut is None:
        return out(F.when(F.col("size") > 0, F.lit(2)).otherwise(F.lit(0)))
    order = Window.orderBy("v", "src", "spot", "_key", "pass", "size")
    last = entry.filter(F.col("range") == cut["range"]).withColumn("used", F.sum("size").over(order) + F.lit(cut["before"])).filter(F.col("used") <= F.lit(budget)).orderBy(*(F.desc(c) for c in ("v", "src", "spot", "_key", "pass", "size"))).first()

    def taken(v: str, pass_: int):
        earlier = F.floor(F.col(v) * TIME_RANGES) < F.lit(cut["range"])
        if last is None:
            return (F.col("size") > 0) & earlier
        # Spots are hashes of key and text, so whoever has the last spot is that row or one like it.
        here = F.struct(F.col(v), F.col("src"), F.col("spot"), F.lit(pass_), F.col("size"))
        there = F.struct(*map(F.lit, (last["v"], last["src"], last["spot"])), F.lit(last["pass"]), F.lit(last["size"]).cast("long"))
        return (F.col("size") > 0) & (earlier | (here <= there))

    return out(taken("v1", 0).cast("int") + taken("v2", 1).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS spot,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)] AS weight FROM d GROUP BY src
), r AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM r WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), q AS (
  SELECT d.*, source_size, target, CAST(2 * sum(size) OVER (PARTITION BY src ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS twice FROM d JOIN t USING (src)
), e AS (
  SELECT *, 0 AS pass, CAST(twice AS DOUBLE) / (2 * target) AS v FROM q WHERE size > 0
  UNION ALL SELECT *, 1 AS pass, CAST(twice + 2 * source_size AS DOUBLE) / (2 * target) AS v FROM q WHERE size > 0
), u AS (
  SELECT *, sum(size) OVER (ORDER BY v, src, spot, doc_id, pass, size ROWS UNBOUNDED PRECEDING) AS used FROM e
), k AS (
  SELECT doc_id, spot, src, size, count(*) AS n FROM u WHERE used <= (SELECT sum(target) FROM t) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.n, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id, spot, src, size)
"""
