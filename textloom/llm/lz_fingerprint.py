"""Document fingerprints from Lempel-Ziv phrases.

A text is split into symbols: words of up to 12 characters, single marks, and the single characters of
longer words and of unspaced text, so that an insertion never shifts the symbols after it. An LZ78 parse extends the current
phrase by a symbol while that phrase is in the dictionary and adds it when it is not. The set of
phrase hashes is the document's dictionary; its minimum-hash signature is the fingerprint. Texts
that compress alike share phrases, and the share of equal signature slots estimates how many.

next_pairs() pairs each document with the next one by ascending key. Keys, ties with text hashes, are
cut into ranges at quantiles of a bounded sample; the first document of a range is also sent to the
range before it, so each range is worked off alone, in one sorted pass that holds two documents at a
time. A key that many rows share is split by text; only rows equal in key and text stay together.

Defined results: null text counts as empty; texts without symbols share the fingerprint of the empty
set; ties of keys are ordered by text hash, then text; null keys come first; the document after the
last is the first (a lone document follows itself); other columns are not read; an empty table gives
an empty table. Keys may be of any type that Spark and Python order alike (numbers, strings, dates).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOL = re.compile(r"\b\w{1,12}\b|\S")
SLOTS = 128
SAMPLED = 20  # documents a range whose keys are sampled
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15

_rng = np.random.default_rng(20240613)
SLOT_MUL = _rng.integers(1, 1 << 32, SLOTS, dtype=np.uint64) | 1
SLOT_ADD = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint64)


class SymbolHashes(dict):
    """Hashes of symbols, kept up to a bound."""

    def __missing__(self, symbol: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[symbol] = h = xxhash.xxh3_64_intdigest(symbol.encode("utf-8", "surrogatepass"))
        return h


_symbols = SymbolHashes()


def phrases(text: str) -> set[int]:
    """Hashes of the phrases of an LZ78 parse; a phrase's hash is its prefix's hash, advanced by a symbol.

    The last phrase may be one that was known already; it adds nothing.
    """
    known: set[int] = set()
    add = known.add
    current = 0
    for h in map(_symbols.__getitem__, SYMBOL.findall(text)):
        current = (current * MULTIPLIER + h) & MASK
        if current not in known:
            add(current)
            current = 0
    return known


def signature(known: set[int]) -> np.ndarray:
    """SLOTS minima, 16 bits of each; all ones for the empty set."""
    if not known:
        return np.full(SLOTS, 0xFFFF, np.uint16)
    x = np.fromiter(known, np.uint64, len(known))
    x ^= x >> np.uint64(32)
    x = x.astype(np.uint32).astype(np.uint64)
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4096):
        mixed = x[at : at + 4096, None] * SLOT_MUL + SLOT_ADD
        np.minimum(low, (mixed & np.uint64(0xFFFFFFFF)).min(axis=0), out=low)
    low = low * np.uint64(0x9E3779B1)
    return ((low >> np.uint64(13)) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    return signature(phrases(text or ""))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def next_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = df.sparkSession
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    share = min(1.0, SAMPLED * n_ranges / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64(key, "_tie"), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))).select(key, "_tie").collect()
    order = sorted(map(_place, *zip(*sample))) if sample else []
    cuts = sorted({order[len(order) * i // n_ranges] for i in range(1, n_ranges)}) if order else []
    ranged = rows.withColumn("_range", _range_of(cuts)(F.col(key).isNotNull(), key, "_tie") if cuts else F.lit(0))
    # One row a range: its first document's key and text hash. The range before it, among those with
    # rows, borrows that document; the first range lends to the last. As many as ranges, at any size.
    heads = {r["_range"]: r["h"] for r in ranged.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key), "_tie")).alias("h")).collect()}
    order = sorted(heads)
    kind = df.schema[key].dataType.simpleString()
    lenders = spark.createDataFrame([(r, heads[r][1], heads[r][2], order[i - 1]) for i, r in enumerate(order)], f"_range int, _head {kind}, _head_tie bigint, _to int")
    lent = ranged.join(F.broadcast(lenders), "_range").filter(F.col(key).eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie")))
    lent = lent.groupBy("_to").agg(F.min("_head").alias(key), F.min("_tie").alias("_tie"), F.min("_text").alias("_text")).select(key, "_text", "_tie", F.col("_to").alias("_range"), F.lit(1).alias("_lent"))
    both = ranged.withColumn("_lent", F.lit(0)).unionByName(lent)
    placed = both.repartition(n_ranges, "_range").sortWithinPartitions("_range", "_lent", key, "_tie", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: list | None = None  # the document that waits for the next one: range, key, text, fingerprint
        closed: int | None = None  # the range whose borrowed document has been used
        out: list[tuple] = []
        for batch in batches:
            schema = schema or pa.schema([(key, batch.schema.field(key).type), *((n, t) for n, t in OUT)])
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for r, k, t, lent_ in zip(*(part.column(c).to_pylist() for c in ("_range", key, "_text", "_lent"))):
                    if lent_ and closed == r:
                        continue
                    mark = fingerprint(t)
                    if held is not None and held[0] == r:
                        changed = edited(held[2], t)
                        other = fingerprint(changed)
                        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((held[1], len(held[2]), digest, held[3].tobytes().hex(), other.tobytes().hex(), likeness(held[3], other), likeness(held[3], mark)))
                    held, closed = (None, r) if lent_ else ([r, k, t, mark], None)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []

    return placed.select("_range", key, "_text", "_lent").mapInArrow(run, _schema(df, key))


def _place(key, tie: int) -> tuple:
    """A document's place in the order: null keys first."""
    return (key is not None, 0 if key is None else key, tie)


def _range_of(cuts: list[tuple]):
    def find(known: pd.Series, keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, _place(k if has else None, t)) for has, k, t in zip(known.tolist(), keys.tolist(), ties.tolist())], dtype="int32")

    return F.pandas_udf(find, "int")


OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _schema(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_pairs(table(spark, sf_dir, "documents"))
