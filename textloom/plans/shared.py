"""Building blocks that keep global order and running totals out of single tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOCAL_DIR = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names; one of our own only in a local session that names none."""
    if not named_dir(spark):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_DIR)


def named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what several later steps read is computed once, and columns stay prunable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{(named_dir(spark) or LOCAL_DIR).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column | str], name: str = "position", value: str | None = None) -> DataFrame:
    """df with its 0-based position in the order (or with the running total of `value` up to each row).

    Rows are range-sorted into partitions; only one total a partition is gathered. The sorted rows are
    cut, so both passes see the same partitions.
    """
    placed = cut(df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    amount = F.lit(1) if value is None else F.col(value)
    parts = placed.groupBy("_part").agg(F.sum(amount).alias("n"))
    before = parts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    joined = placed.join(F.broadcast(before), "_part")
    if value is None:
        inner = F.col("_row") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    else:
        inner = F.sum(value).over(Window.partitionBy("_part").orderBy("_row"))
    return joined.withColumn(name, F.col("_before") + inner).drop("_part", "_row", "_before")


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`: an aggregate with partial results, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    found = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return found.select(*keys, *(F.col("_first")[c].alias(c) for c in (order, *rest))).select(*df.columns)
