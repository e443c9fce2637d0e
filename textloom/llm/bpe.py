"""Byte-level BPE encoding and decoding.

Texts are cut by the vectorised pre-tokenisation of `pretokenize`; each distinct slice is merged
once by rank order and cached; the ids keep the byte offset at which each ends, so any byte range
decodes without decoding what stands before it.

Defined results: null text counts as empty and gives an empty id array; repeated rows give repeated
rows; only the key and text columns are read, so other columns cannot clash; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_batches
from .pretokenize import SliceCache, runs


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_slice(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank.

    Short slices are scanned for their minimum; for long ones a heap over a linked list of parts
    keeps the work at n log n.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merge_short(piece, ranks) if len(piece) <= 48 else merge_long(piece, ranks)


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    none, get = 1 << 60, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        parts[i] += parts.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = get(parts[i] + parts[i + 1], none)
        if i:
            rank[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = nxt[i]
        if j >= n or end[j] != stop:
            continue
        end[i] = stop
        alive[j] = False
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        p = prv[i]
        if p >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


@lru_cache(2)
def slice_cache(path: str) -> SliceCache:
    """One cache for each worker process and vocabulary."""
    ranks = load_ranks(path)
    return SliceCache(lambda pieces: [merge_slice(p.encode("utf-8"), ranks) for p in pieces])


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes, start by id, length by id)."""
    ranks = load_ranks(path)
    order = sorted(ranks.items(), key=lambda x: x[1])
    top = order[-1][1] + 1
    length = np.zeros(top, np.int64)
    for token, rank in order:
        length[rank] = len(token)
    return np.frombuffer(b"".join(t for t, _ in order), np.uint8), np.cumsum(length) - length, length


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, key: str, text: str, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(key, *keep, ids, ends) of each batch."""
    cache, (_, _, length) = slice_cache(vocabulary), token_bytes(vocabulary)
    for batch, texts in text_batches(batches, text):
        ids, count = cache.encode(texts)
        ends = np.cumsum(length[ids])
        bound = np.concatenate([[0], np.cumsum(count)])
        before = np.concatenate([[0], ends])[bound[:-1]]
        ends = (ends - np.repeat(before, count)).astype(np.int32)
        bound = pa.array(bound, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *keep)), pa.ListArray.from_arrays(bound, pa.array(ids)), pa.ListArray.from_arrays(bound, pa.array(ends))], names=[key, *keep, "ids", "ends"])


def decode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, columns: tuple[str, ...], most_ids: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(*columns, decoded), in parts of `most_ids` ids at most (one row at least)."""
    flat, start, length = token_bytes(vocabulary)
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + most_ids, "right")))
            part = batch.slice(at, stop - at)
            at = stop
            ids = part.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False)
            count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = flat[runs(start[values], length[values])]
            # The last offset of each row is its length in bytes.
            bound = np.concatenate([[0], np.cumsum(count)])
            ends = part.column("ends").flatten().to_numpy(zero_copy_only=False)
            size = np.zeros(len(count), np.int64)
            size[count > 0] = ends[bound[1:][count > 0] - 1]
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            decoded = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), decoded], names=[*columns, "decoded"])


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, ends array<int>): ends[i] is the byte offset at which token i ends."""
    return arrow_map(df.select(key, text), lambda batches: encode_batches(batches, vocabulary, key, text), f"{_kinds(df, (key,))}, ids array<int>, ends array<int>")


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, decoded binary) from the ids and ends of encode(). Null ids count as empty."""
    columns = (key, *keep)
    return arrow_map(df.select(*dict.fromkeys([*columns, "ids", "ends"])), lambda batches: decode_batches(batches, vocabulary, columns), f"{_kinds(df, columns)}, decoded binary")


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded binary): decode() over encode(), in one worker process instead of two a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decode_batches(encode_batches(batches, vocabulary, key, text), vocabulary, (key, "ids"))

    return arrow_map(df.select(key, text), run, f"{_kinds(df, (key,))}, ids array<int>, decoded binary")


def decode_range(ids: list[int], ends: list[int], start: int, stop: int, vocabulary: str) -> bytes:
    """Bytes start..stop of a document from its ids and offsets alone; only the tokens there are read."""
    flat, first, length = token_bytes(vocabulary)
    a = int(np.searchsorted(ends, start, "right"))
    b = int(np.searchsorted(ends, stop, "left")) + 1
    part = np.asarray(ids[a:b], np.int64)
    base = int(ends[a - 1]) if a else 0
    return flat[runs(first[part], length[part])].tobytes()[start - base : stop - base]


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) from the operator's outputs."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return round_trip(df, vocabulary, key).select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
