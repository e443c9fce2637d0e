"""Media columns in content-defined chunks.

A text's bytes, padded with zero bytes to a positive multiple of 64, become the samples of an 8-bit
mono WAV file. A rolling gear hash cuts the file into chunks; equal chunks are stored once, and an
ordered chunk list with the file's SHA-256 rebuilds and verifies every file.

What moves between machines is only what is shared. Chunk digests (no bytes) are counted first; the
digests that occur more than once mark a bitmap of fixed size. A chunk whose bit is clear is unique
and is stored with its own file's row, without a shuffle; a chunk whose bit is set goes to a store
keyed by digest, deduplicated by a Spark aggregate. A bitmap that fills up as data grows only sends
more chunks to the keyed store; results do not change. Files with shared chunks are rebuilt once for
each distinct file, however many rows hold it.

Defined results: null text counts as empty (64 zero bytes); equal texts have equal results; repeated
rows repeat; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, lookup_skewed, table, text_batches

PAD = 64
HEADER = 44
RATE = 8000
#: Chunk sizes: a cut where the gear hash's upper bits are clear, at least MIN and at most MAX bytes apart.
MIN, MAX, CUT_BITS = 256, 8192, 10
WINDOW = 32  # bytes that a 32-bit gear hash depends on
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
BITMAP_BITS = 26  # 8 MB


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def wav(samples: bytes) -> bytes:
    """An 8-bit mono PCM file; len(samples) is even, so no pad byte is due."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    riff, _, kind, fmt, size, coding, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, fmt, size, coding, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or n != len(media) - HEADER:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER:]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(media)
    if n <= MIN:
        return [n]
    marks = np.flatnonzero(gear(np.frombuffer(media, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends: list[int] = []
    start, i, marks = 0, 0, marks.tolist()
    while n - start > MAX or i < len(marks):
        while i < len(marks) and marks[i] - start < MIN:
            i += 1
        stop = marks[i] if i < len(marks) and marks[i] - start <= MAX else start + MAX
        if stop >= n:
            break
        ends.append(stop)
        start = stop
    return [*ends, n]


def chunks(media: bytes) -> list[bytes]:
    ends = cut_points(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def bit_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little") & ((1 << BITMAP_BITS) - 1)


def features(samples: bytes) -> str:
    """Mean, standard deviation, zero crossings, peak and energy of eight equal parts of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    parts = np.sqrt((x.reshape(8, -1) ** 2).mean(axis=1))
    return f"mean={x.mean():.4f};std={x.std():.4f};zc={crossings};peak={int(np.abs(x).max())};rms=" + ",".join(f"{p:.3f}" for p in parts)


def described(media: bytes) -> tuple:
    """What a stored file gives when it is read back: FACTS without n_bytes, which is each row's own."""
    samples = samples_of(media)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)


FACTS = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
ARROW = {"bigint": pa.int64(), "string": pa.string()}
CHUNK = pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])


def chunk_digests(df: DataFrame, text: str) -> DataFrame:
    """One row for each chunk of each file: its digest and its bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, text):
            found = [digest(c) for t in texts for c in chunks(wav(payload(t)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(map(bit_of, found), pa.int64())], names=["digest", "bit"])

    return arrow_map(df.select(text), run, "digest binary, bit bigint")


def shared_bits(digests: DataFrame) -> bytes:
    """The bitmap of digests that occur more than once: 2^BITMAP_BITS bits, whatever the data's size."""
    repeated = digests.groupBy("digest").agg(F.first("bit").alias("bit"), F.count("*").alias("n")).filter("n > 1")
    blocks = repeated.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    whole = bytearray((1 << BITMAP_BITS) // 8 + 4096)
    for r in blocks:
        at = (r["block"] - 1) * 4096 if BLOCKS_FROM_ONE else r["block"] * 4096
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


#: bitmap_bucket_number() counts from 1.
BLOCKS_FROM_ONE = True


def bit_set(bitmap: bytes, bit: int) -> bool:
    """bitmap_bucket_number() puts value v > 0 in bucket 1 + (v - 1) / 32768 at position (v - 1) % 32768, and 0 in bucket 0 at 0."""
    at = bit - 1
    if bit == 0:
        return True  # the one value of bucket 0: treated as shared
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def store(df: DataFrame, key: str = "doc_id", text: str = "text", space: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes (files, shared chunks). files: key, media, n_bytes, chunks (digest, bytes; no bytes where shared), whole.

    Shared chunks: digest, bytes, and how often rows use them. A chunk that very many files use is met by broadcast.
    """
    spark = df.sparkSession
    space = space or Workspace(spark, "media")
    df = df.select(key, text)
    bitmap = spark.sparkContext.broadcast(shared_bits(chunk_digests(df, text)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch, texts in text_batches(batches, text):
            names, sizes, lists, whole = [], [], [], []
            for t in texts:
                samples = payload(t)
                media = wav(samples)
                got = [(d := digest(c), None if bit_set(bits, bit_of(d)) else c) for c in chunks(media)]
                names.append(hashlib.sha256(media).digest())
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                lists.append([{"digest": d, "bytes": c} for d, c in got])
                whole.append(all(c is not None for _, c in got))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(CHUNK)), pa.array(whole)], names=[key, "media", "n_bytes", "chunks", "whole"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for _, texts in text_batches(batches, text):
            got: dict[bytes, bytes] = {}
            uses: Counter = Counter()
            for c in (c for t in texts for c in chunks(wav(payload(t)))):
                if bit_set(bits, bit_of(d := digest(c))):
                    got[d] = c
                    uses[d] += 1
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(got.values(), pa.binary()), pa.array([uses[d] for d in got], pa.int64())], names=["digest", "bytes", "uses"])

    kind = df.schema[key].dataType.simpleString()
    files = space.write(arrow_map(df, rows, f"{key} {kind}, media binary, n_bytes bigint, chunks array<struct<digest:binary,bytes:binary>>, whole boolean"), "files")
    kept = arrow_map(df, shared, "digest binary, bytes binary, uses bigint").groupBy("digest").agg(F.first("bytes").alias("bytes"), F.sum("uses").alias("uses"))
    kept = space.write(kept, "shared")
    return files, kept


def verified(parts: list[bytes], name: bytes) -> bytes:
    media = b"".join(parts)
    if hashlib.sha256(media).digest() != name:
        raise ValueError("a rebuilt file differs from what was stored")
    return media


def facts(files: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, FACTS): every stored file read back, verified and described."""
    kind = files.schema[key].dataType.simpleString()
    schema = ", ".join(f"{n} {t}" for n, t in FACTS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said = [(n, *described(verified([c["bytes"] for c in got], name))) for name, n, got in zip(*(part.column(c).to_pylist() for c in ("media", "n_bytes", "chunks")))]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array([s[i] for s in said], ARROW[t]) for i, (_, t) in enumerate(FACTS))], names=[key, *(n for n, _ in FACTS)])

    alone = arrow_map(files.filter("whole").select(key, "media", "n_bytes", "chunks"), own, f"{key} {kind}, {schema}")

    # Files with shared chunks: each distinct one is rebuilt once, then looked up by the rows that hold it.
    some = files.filter("not whole")
    distinct = some.groupBy("media").agg(F.first("chunks").alias("chunks"), F.count("*").alias("holders"))
    pieces = distinct.select("media", "holders", F.posexplode("chunks").alias("seq", "chunk")).select("media", "holders", "seq", "chunk.*")
    present = pieces.filter("bytes is not null")
    fetched = lookup_skewed(pieces.filter("bytes is null").drop("bytes"), kept, "digest", "uses").select(*present.columns)
    whole = present.unionByName(fetched).groupBy("media", "holders").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("parts"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said = [described(verified([c["bytes"] for c in got], name)) for name, got in zip(*(part.column(c).to_pylist() for c in ("media", "parts")))]
                yield pa.RecordBatch.from_arrays([part.column("media"), part.column("holders"), *(pa.array([s[i] for s in said], ARROW[t]) for i, (_, t) in enumerate(FACTS[1:]))], names=["media", "holders", *(n for n, _ in FACTS[1:])])

    about = ", ".join(f"{n} {t}" for n, t in FACTS[1:])
    once = arrow_map(whole.select("media", "holders", "parts"), rebuilt, f"media binary, holders bigint, {about}")
    once = Workspace(files.sparkSession, "media-facts").write(once, "once")
    others = lookup_skewed(some.select(key, "media", "n_bytes"), once, "media", "holders")
    return alone.unionByName(others.select(key, *(n for n, _ in FACTS)))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(*store(table(spark, sf_dir, "documents")))
