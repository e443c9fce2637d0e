"""Evaluation: pooling, precision at k, overlap between rankings, equality of normalisations."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool(results: DataFrame, k: int) -> DataFrame:
    """results (system, query_id, rank, doc_id) → (query_id, doc_id, ranks): `system:rank` in order of systems."""
    marks = F.array_sort(F.collect_list(F.concat("system", F.lit(":"), F.col("rank").cast("string"))))
    return results.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.array_join(marks, " ").alias("ranks"))


def extract(text):
    """260 characters of collapsed text from the 900 after the first line."""
    rest = F.substring(text, F.length(F.substring_index(text, "\n", 1)) + 2, 900)
    return F.substring(F.trim(F.regexp_replace(rest, r"\s+", " ")), 1, 260)


def merge_marks(pooled: DataFrame, old: DataFrame) -> DataFrame:
    """The pool with earlier marks (query_id, doc_id, relevant); new pairs have none."""
    return pooled.join(old, ["query_id", "doc_id"], "left")


def precision(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(system, query_id, p_at_k, unjudged): relevant ones in the first k by k itself; unjudged ones are counted.

    judged: (query_id, doc_id, relevant), or (doc_id, relevant) where marks hold for every query.
    """
    top = results.filter(F.col("rank") <= k).join(judged, [c for c in ("query_id", "doc_id") if c in judged.columns], "left")
    return top.groupBy("system", "query_id").agg((F.coalesce(F.sum("relevant"), F.lit(0)) / F.lit(k)).alias("p_at_k"), F.sum(F.col("relevant").isNull().cast("bigint")).alias("unjudged"))


def macro_average(per_query: DataFrame, queries: DataFrame, systems: DataFrame) -> DataFrame:
    """Mean over all queries; one without results counts as 0. queries × systems is the table's own shape."""
    grid = queries.select("query_id").crossJoin(F.broadcast(systems.select("system")))
    return grid.join(per_query, ["system", "query_id"], "left").groupBy("system").agg(F.avg(F.coalesce("p_at_k", F.lit(0.0))).alias("mean_p"))


def overlap(results: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(overlap, same_first, queries): shared documents of the first k by k, averaged over queries with any result."""
    top = results.filter((F.col("rank") <= k) & F.col("system").isin(a, b))
    per_doc = top.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.max("rank").alias("worst"))
    per_query = per_doc.groupBy("query_id").agg((F.sum((F.col("n") == 2).cast("int")) / F.lit(k)).alias("o"), F.max(((F.col("n") == 2) & (F.col("worst") == 1)).cast("int")).alias("same"))
    return per_query.agg(F.coalesce(F.avg("o"), F.lit(0.0)).alias("overlap"), F.coalesce(F.sum("same"), F.lit(0)).cast("bigint").alias("same_first"), F.count("*").alias("queries"))


def equal_terms(pairs: DataFrame) -> DataFrame:
    """pairs (terms_a, terms_b) → documents, equal ones and their share."""
    same = F.col("terms_a").eqNullSafe(F.col("terms_b")).cast("bigint")
    return pairs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(same), F.lit(0)).alias("equal")).withColumn("share", F.try_divide(F.col("equal").cast("double"), F.col("documents")))


def replacements(pairs: DataFrame, top: int = 20) -> DataFrame:
    """The commonest replacements between the two term lists: (before, after, n)."""

    def run(a, b):
        def one(x, y):
            ops = SequenceMatcher(None, list(x), list(y), autojunk=False).get_opcodes()
            return [f"{' '.join(x[i:j])}\t{' '.join(y[k:m])}" for op, i, j, k, m in ops if op != "equal"]

        return a.combine(b, one)

    found = pairs.filter(~F.col("terms_a").eqNullSafe(F.col("terms_b"))).select(F.explode(F.pandas_udf(run, "array<string>")("terms_a", "terms_b")).alias("r"))
    parts = F.split("r", "\t")
    return found.groupBy("r").agg(F.count("*").alias("n")).select(parts[0].alias("before"), parts[1].alias("after"), "n").orderBy(F.desc("n"), "before", "after").limit(top)
