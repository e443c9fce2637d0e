"""List files, repositories of text files, logs, pools and stats: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "ts double, url string, host string, depth int, outcome string, source string, words bigint, bytes bigint, published_at string, ms int, topic_hits int, chars bigint, status int, error string"


def lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines without blank ones and comments."""
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return raw.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path))


def fields(listed: DataFrame, separator: str) -> DataFrame:
    """(head, item, pos): the first field of each line with each of the others."""
    parts = F.transform(F.split("line", separator), lambda x: F.trim(x))
    return listed.select(parts[0].alias("head"), F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "item"))


def lemmas(listed: DataFrame) -> DataFrame:
    return listed.filter(F.col("line").contains("\t")).select(F.substring_index("line", "\t", 1).alias("word"), F.regexp_extract("line", r"\t(.*)$", 1).alias("lemma"))


def queries(listed: DataFrame) -> DataFrame:
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    return listed.select(parts[0].alias("query_id"), parts[1].alias("text"))


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    """(host, hash, text) of a tree host/two hex digits/hash.txt; bytes are decoded leniently, names of other lengths are skipped."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)/[^/]+/([^/]{64})\.txt$", 2)
    host = F.regexp_extract("path", r"([^/]+)/[^/]+/([^/]{64})\.txt$", 1)
    return found.select(host.alias("host"), name.alias("hash"), decoded(F.col("content")).alias("text")).filter("hash <> ''")


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters where bytes are no valid text."""
    return F.pandas_udf(lambda values: values.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace")), "string")(content)


def write_repository(docs: DataFrame, path: str) -> None:
    """Documents as a table by host; content decides identity upstream, so a retry writes the same rows."""
    docs.write.mode("overwrite").partitionBy("host").parquet(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def write_stats(one: DataFrame, path: str) -> None:
    one.write.mode("overwrite").json(path)


def write_pool(pooled: DataFrame, path: str) -> None:
    pooled.write.mode("overwrite").option("header", "true").csv(path)
