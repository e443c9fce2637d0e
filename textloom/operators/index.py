"""Inverted index as plain tables: postings, dictionary, documents, with gaps, byte sizes, fingerprint and a stored layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import varint_length
from ..functions.normalize import with_terms
from ..plans.policy import Policy
from ..plans.shared import numbered, stored

HEADER_BYTES = 96
DOCUMENT_BYTES = 42
BLOCK = 1 << 16  # document ids of a block of postings
VERSION = 1


@dataclass
class Index:
    """docs: doc_id, host, n_tokens, norm; postings: term, doc_id, tf; dictionary: term, df, cf, idf."""

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    n_docs: int


def assign_ids(docs: DataFrame, host: str, content: str) -> DataFrame:
    """doc_id: position in (host, content) order, from a range sort."""
    return numbered(docs, [host, content], "doc_id")


def lengths(termed: DataFrame, key: str = "doc_id") -> DataFrame:
    return termed.select(key, "host", F.size("terms").cast("bigint").alias("n_tokens"))


def postings(termed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf). Counts are made of exploded terms with partial sums before the shuffle."""
    return termed.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def dictionary(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def with_idf(terms: DataFrame, n_docs) -> DataFrame:
    return terms.withColumn("idf", F.log10(F.lit(n_docs) / F.col("df")))


def weight(tf="tf", idf="idf"):
    return (F.lit(1.0) + F.log10(F.col(tf).cast("double"))) * F.col(idf)


def norms(post: DataFrame, terms: DataFrame, lens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, host, n_tokens, norm): norm as a 32-bit float; documents without weight have 1."""
    squares = post.join(terms.select("term", "idf"), "term").groupBy(key).agg(F.sqrt(F.sum(weight() * weight())).alias("n"))
    return lens.join(squares, key, "left").select(key, "host", "n_tokens", F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(1.0)).cast("float").alias("norm"))


def build(docs: DataFrame, policy: Policy, key: str = "doc_id", host: str = "source") -> Index:
    """docs (doc_id, host, text) → index. Terms and postings are stored, so texts are read and tokenised once."""
    termed = stored(with_terms(docs.select(key, F.col(host).alias("host"), "text"), policy).select(key, "host", "terms"), "terms")
    post = stored(postings(termed, key), "postings")
    n = termed.count()
    terms = with_idf(dictionary(post), n)
    return Index(norms(post, terms, lengths(termed, key), key), post, terms, n)


def gaps(post: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf, gap): differences of document ids within a term.

    A term's postings are split by blocks of document ids, as a stopword stands in all documents; a
    block's first gap is to the end of the term's block before it, one row a term and block.
    """
    placed = stored(post, "postings").withColumn("_block", F.floor(F.col(key) / BLOCK))
    ends = placed.groupBy("term", "_block").agg(F.max(key).alias("_end"))
    before = ends.select("term", "_block", F.lag("_end", 1, 0).over(Window.partitionBy("term").orderBy("_block")).alias("_before"))
    inside = F.lag(key).over(Window.partitionBy("term", "_block").orderBy(key))
    return placed.join(before, ["term", "_block"]).withColumn("gap", F.col(key) - F.coalesce(inside, F.col("_before"))).drop("_block", "_before")


def ungap(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document ids from gaps, which are in document order as stored: sums of whole blocks, then within a block."""
    placed = coded.withColumn("_block", F.floor(F.col(key) / BLOCK))
    sums = placed.groupBy("term", "_block").agg(F.sum("gap").alias("_sum"))
    upto = Window.partitionBy("term").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.select("term", "_block", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"))
    inside = F.sum("gap").over(Window.partitionBy("term", "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.join(before, ["term", "_block"]).withColumn("decoded", F.col("_before") + inside).drop("_block", "_before")


def entry_sizes(post: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, payload_bytes, entry_bytes): varint sizes of postings and of the dictionary entry."""
    sized = gaps(post, key).groupBy("term").agg(F.count("*").alias("df"), F.sum(varint_length(F.col("gap")) + varint_length(F.col("tf"))).alias("payload_bytes"))
    entry = F.lit(1) + F.octet_length("term") + varint_length(F.col("df")) + varint_length(F.col("payload_bytes"))
    return sized.withColumn("entry_bytes", entry.cast("bigint"))


def info(lens: DataFrame, sizes: DataFrame, policy_text: str) -> DataFrame:
    """One row: counts, section offsets and total bytes of the binary layout."""
    hosts = lens.select("host").distinct().agg(F.count("*").alias("hosts"), (F.lit(4) + F.coalesce(F.sum(F.octet_length("host") + 2), F.lit(0))).alias("host_bytes"))
    docs = lens.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    terms = sizes.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("entry_bytes"), F.lit(0)).alias("dictionary_bytes"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("payload_bytes"))
    one = docs.crossJoin(hosts).crossJoin(terms)  # one row each
    meta = HEADER_BYTES + 4 + len(policy_text.encode())
    at_docs = F.lit(meta) + F.col("host_bytes")
    at_terms = at_docs + DOCUMENT_BYTES * F.col("documents")
    at_postings = at_terms + F.col("dictionary_bytes")
    return one.select(
        "documents", "terms", "postings", "tokens", "hosts", F.lit(HEADER_BYTES).cast("bigint").alias("at_meta"), F.lit(meta).cast("bigint").alias("at_hosts"), at_docs.alias("at_docs"), at_terms.alias("at_dictionary"),
        at_postings.alias("at_postings"), (at_postings + F.col("payload_bytes")).alias("bytes"),
    )


def fingerprint(docs: DataFrame, policy_text: str, limit: int, content: str = "hash") -> DataFrame:
    """One row: a digest of all that decides an index's content.

    Document hashes are combined by sums of their parts, in any order and any number of tasks.
    """
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(content, at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    head = f"{VERSION}|{limit}|{policy_text}|"
    return docs.agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(13).alias("b")).select(F.sha2(F.concat(F.lit(head), F.concat_ws("|", "n", "a", "b")), 256).alias("fingerprint"))


def write(index: Index, path: str, policy_text: str = "") -> None:
    """Three tables: postings and dictionary range-sorted by term (row groups prune by term), documents by id.

    A fingerprint beside them tells whether a rebuild is due; Spark's committer publishes each table whole.
    """
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.dictionary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.docs.sparkSession.createDataFrame([(index.n_docs, policy_text)], "n_docs long, policy string").write.mode("overwrite").json(f"{path}/info")


def read(spark: SparkSession, path: str) -> Index:
    info_ = spark.read.schema("n_docs long, policy string").json(f"{path}/info").first()
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/dictionary"), info_["n_docs"])
