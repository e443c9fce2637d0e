"""Ranked search: query vectors, term-at-a-time accumulation, cosine top-k, and the classic similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import with_terms
from ..plans.policy import Policy
from .index import Index, weight

TOP = 10


def query_terms(queries: DataFrame, policy: Policy, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, tfq) under the policy of the index."""
    termed = with_terms(queries.select(key, F.col(text).alias("text")), policy)
    return termed.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tfq"))


def query_vectors(counted: DataFrame, dictionary: DataFrame, key: str = "query_id") -> DataFrame:
    """(query_id, term, tfq, idf, wq): terms outside the dictionary are dropped before any norm."""
    return counted.join(dictionary.select("term", "idf"), "term").select(key, "term", "tfq", "idf", weight("tfq").alias("wq"))


def scores(vectors: DataFrame, index: Index, key: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score) with score > 0. Both sides carry idf.

    Query norms ride along as a sum over the query's own vector; postings meet query terms by term.
    """
    normed = vectors.withColumn("qn", F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(Window.partitionBy(key))))
    hits = normed.join(index.postings, "term").groupBy(key, "doc_id").agg(F.sum(F.col("wq") * weight()).alias("dot"), F.first("qn").alias("qn"))
    cosine = F.try_divide(F.col("dot"), F.col("norm").cast("double") * F.col("qn"))
    return hits.join(index.docs.select("doc_id", "norm"), "doc_id").select(key, "doc_id", cosine.alias("score")).filter("score > 0")


def top_k(scored: DataFrame, k: int = TOP, key: str = "query_id") -> DataFrame:
    """(query_id, rank, doc_id, score); ties by document id. Each task keeps k rows a query before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "rank", "doc_id", "score")


def search(queries: DataFrame, index: Index, policy: Policy, k: int = TOP, key: str = "query_id", text: str = "text") -> DataFrame:
    return top_k(scores(query_vectors(query_terms(queries, policy, key, text), index.dictionary, key), index, key), k, key)


def byte_length(n):
    """A document length as one byte of precision keeps it: exact below 40, then three bits after the leading one."""
    x = n - 24
    e = F.greatest(F.floor(F.log2(x.cast("double") + 0.5)) - 3, F.lit(0)).cast("int")
    kept = F.floor(x / F.pow(F.lit(2.0), e)) * F.pow(F.lit(2.0), e)
    return F.when(n < 40, n.cast("double")).otherwise(F.lit(24.0) + kept)


def classic(queries: DataFrame, index: Index, policy: Policy, k: int | None = TOP, key: str = "query_id", idf_power: int = 2) -> DataFrame:
    """A disjunction with one clause per term occurrence: √tf · idf^power / √length, idf = 1 + ln((N+1)/(df+1)).

    Without k, (query_id, doc_id, score) of all documents that a query meets.
    """
    idf = F.lit(1.0) + F.log(F.lit(index.n_docs + 1) / (F.col("df") + 1))
    clauses = query_terms(queries, policy, key).join(index.dictionary.select("term", "df"), "term").select(key, "term", "tfq", idf.alias("idf"))
    hits = clauses.join(index.postings, "term").join(index.docs.select("doc_id", "n_tokens"), "doc_id")
    part = F.col("tfq") * F.sqrt(F.col("tf").cast("double")) * F.pow("idf", F.lit(idf_power)) / F.sqrt(byte_length(F.col("n_tokens")))
    scored = hits.groupBy(key, "doc_id").agg(F.sum(part).alias("score"))
    return scored if k is None else top_k(scored, k, key)


def present(results: DataFrame, docs: DataFrame, host: str = "source") -> DataFrame:
    """Rank, score, host and first line (80 characters) of each result."""
    shown = docs.select("doc_id", F.col(host).alias("host"), F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 80).alias("title"))
    return results.join(shown, "doc_id").select("query_id", "rank", "score", "host", "title", "doc_id")


def latency(timings: DataFrame, key: list[str], ms: str = "ms") -> DataFrame:
    """Median and maximum of the repetitions."""
    return timings.groupBy(*key).agg(F.percentile(ms, F.lit(0.5)).alias("median_ms"), F.max(ms).alias("max_ms"))
