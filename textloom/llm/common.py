"""Shared plumbing: tables, the shared work folder, Arrow helpers and skew-safe lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local session that names no spark.checkpoint.dir (tests).
LOCAL_SHARED = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return LOCAL_SHARED


class Workspace:
    """Parquet tables in the shared folder.

    A written table cuts lineage the way checkpoint() does, keeps columns prunable, and survives
    lost executors. drop() removes a table once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices Arrow batches so that each holds about `limit` characters at most (one row at least).

    Null texts become empty ones. The slice bounds the working memory of vectorised steps.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, held = i, 0
            held += n
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(column).to_pylist()]


#: Bytes of an Arrow batch on its way to a worker. The default of 64 MB, held several times over while a batch of long
#: texts is built, is a large part of a small executor.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes. The bound is a setting of the session, read when the plan runs, so it stays set; results do not depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(fn, schema)


def lookup_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", shares: int = 1000) -> DataFrame:
    """left ⋈ right on `key`, where right has one row per key and `weight` says how many left rows it meets.

    Keys that hold over 1/shares of all weight are at most `shares` rows, so these are broadcast
    (a bound that holds at every size); all other keys are joined by shuffle.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("w")).first()["w"]
    hot_if = F.col(weight) * F.lit(shares) > F.lit(int(total))
    hot = right.filter(hot_if).drop(weight)
    rest = right.filter(~hot_if).drop(weight)
    hot_keys = hot.select(F.col(key), F.lit(True).alias("_is_hot"))
    marked = left.join(F.broadcast(hot_keys), key, "left")
    on_hot = marked.filter("_is_hot").drop("_is_hot").join(F.broadcast(hot), key, "inner")
    on_rest = marked.filter("_is_hot is null").drop("_is_hot").join(rest, key, how)
    return on_hot.unionByName(on_rest)


SIEVE_BITS = 25


def sieved(df: DataFrame, by: Column, wanted: DataFrame, wanted_by: Column) -> DataFrame:
    """df with `_maybe`: false only where `by` (64-bit hashes) is none of the wanted hashes.

    A bitmap of 2^SIEVE_BITS bits is broadcast in words of 64: half a million rows at most, whatever
    the data's size. Rows that it rules out need not be shuffled to meet `wanted`; as it fills, it
    rules out fewer, and a join has the last word either way.
    """
    place = lambda h: F.pmod(h, F.lit(1 << SIEVE_BITS))
    word, bit = (lambda h: F.shiftright(place(h), 6)), (lambda h: (place(h) % 64).cast("int"))
    bits = wanted.select(word(wanted_by).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(wanted_by)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_hash", by).withColumn("_word", word(F.col("_hash"))).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.bit_get("_bits", bit(F.col("_hash"))) == 1, F.lit(False))).drop("_hash", "_word", "_bits")
