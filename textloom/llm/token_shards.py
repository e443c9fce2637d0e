"""Token-id output: shards of Re-Pair compressed ids with random access.

Documents are range-sorted by key, encoded, closed by an end id and packed into shards. Each shard
holds a grammar: the frequent id pairs are replaced by nonterminals, round after round, and the
file keeps rules, expansion lengths, the remaining sequence and each document's place in it, so one
document (or a range of its ids) is expanded without its neighbours.

A text is encoded as the library's encode(text, add_special_tokens=False) does it: the tokenizer's
added tokens, special ones too, are one id each wherever their string stands in a text.

Defined results: null text counts as empty (its only id is the end id); null keys come first; rows
with equal keys are ordered by text hash, then text, and each keeps its own entry; other columns are
not read, so their names cannot clash; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, table, text_batches
from .pretokenize import SliceCache, room, runs

MAGIC = b"RPR1"
END_ID = 0
HEAD = struct.Struct("<4sIIII")
MOST_IDS = 1 << 21  # of an Arrow batch of expanded ids, or one document


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class AddedTokens:
    """Encodes texts as the library does: added tokens are cut out first (leftmost, then longest), each is one id, and the text between them is sliced on its own."""

    def __init__(self, cache: SliceCache, added: list[dict]):
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens of this tokenizer are not plain strings")
        self.cache = cache
        self.ids = {t["content"]: t["id"] for t in added if t["content"]}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if self.ids else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has)."""
        if not self.pattern or not any(map(self.pattern.search, texts)):
            return self.cache.encode(texts)
        parts = [self.pattern.split(t) for t in texts]  # text at even places, added tokens between
        flat, count = self.cache.encode([x for p in parts for x in p[::2]])
        per_text = np.fromiter((len(p) // 2 + 1 for p in parts), np.int64, len(parts))
        ends = np.cumsum(per_text)
        between = np.ones(len(count), bool)
        between[ends - 1] = False
        flat = np.insert(flat, np.cumsum(count)[between], [self.ids[x] for p in parts for x in p[1::2]])
        return flat, np.add.reduceat(count + between, ends - per_text)


@lru_cache(2)
def tokenizer_cache(path: str) -> tuple[AddedTokens, int]:
    """(cache over the library's BPE model behind its added tokens, size of the vocabulary), one for each worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    kind = stored["pre_tokenizer"]
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
        raise ValueError("slices of this tokenizer are not those of the byte-level pattern")
    letters, model = byte_letters(), tokenizer.model

    def encode(pieces: list[str]) -> list[list[int]]:
        spelt = b"\xff".join(p.encode("utf-8") for p in pieces).decode("latin-1").translate(letters)
        return [[t.id for t in model.tokenize(p)] for p in spelt.split(letters[0xFF])]  # a byte that UTF-8 has not

    return AddedTokens(SliceCache(encode), stored.get("added_tokens") or []), tokenizer.get_vocab_size()


def compress(ids: np.ndarray, doc_len: np.ndarray, first: int, min_count: int = 4, fall: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules [n, 2], expansion lengths, document starts in the sequence).

    Re-Pair in rounds: a round replaces, left to right, the pairs whose count is within a factor of
    `fall` of the most frequent one's; pairs never cross a document's end. Rounds go on until no pair
    occurs `min_count` times. A rule takes three words of a shard (its pair and its length), so a pair
    that occurs three times saves nothing: 4 is the least count that makes a shard smaller. A count
    of 2 runs to the end of the classic algorithm, and `fall` towards 1 takes its order; the README
    gives measured sizes.

    Counts never rise: a new pair holds a new symbol. So a pair seen too seldom is never looked at
    again, and a round touches only the places of its pairs and the pairs beside its replacements.
    """
    n = len(ids)
    seq = np.append(ids, [0, 0]).astype(np.int32)  # two places more: the end, and what stands before the start
    last = np.zeros(n + 2, bool)
    last[np.cumsum(doc_len) - 1] = last[n:] = True
    after, before = np.arange(1, n + 3, dtype=np.int32), np.arange(-1, n + 1, dtype=np.int32)
    gone = np.zeros(n, bool)
    pair = np.full(n + 2, -1, np.int32)  # number of the pair that begins here, -1 if too rare
    # Of each numbered pair: symbols, count, and where its places begin in `places`, which keeps stale ones.
    lefts, rights, places = (np.zeros(1, np.int32) for _ in range(3))
    counts, begins = np.zeros(1, np.int64), np.zeros(1, np.int64)
    n_pairs = n_places = 0
    rules: list[np.ndarray] = []
    length = np.ones(first, np.int64)
    fresh = np.flatnonzero(~last[:n]).astype(np.int32)
    while True:
        # Number the new pairs. Counts of hashed pairs bound true counts from above and pick what is sorted.
        wide = len(length).bit_length()
        code = seq[fresh].astype(np.int64)
        code <<= wide
        code |= seq[after[fresh]] if n_pairs else seq[fresh + 1]
        if n_pairs:  # of all pairs of a text most are frequent
            bits = max(10, len(fresh).bit_length())
            bucket = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
            often = (np.bincount(bucket, minlength=1 << bits) >= min_count)[bucket]
            fresh, code = fresh[often], code[often]
        deep = len(fresh).bit_length()
        if 2 * wide + deep < 63:  # code and place in one word sort faster than an order of codes
            code <<= deep
            code |= np.arange(len(fresh))
            code.sort()
            fresh = fresh[code & ((1 << deep) - 1)]
            ranked = code >> deep
        else:
            order = np.argsort(code)
            ranked, fresh = code[order], fresh[order]
        head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(ranked)))
        frequent = times >= min_count
        head, number = head[frequent], n_pairs + np.arange(int(frequent.sum()))
        fresh = fresh[np.repeat(frequent, times)]
        times = times[frequent]
        pair[fresh] = np.repeat(number, times)
        at, n_pairs, filled, n_places = n_pairs, n_pairs + len(head), n_places, n_places + len(fresh)
        lefts, rights, count, begins, places = (room(x, n) for x, n in ((lefts, n_pairs), (rights, n_pairs), (counts, n_pairs), (begins, n_pairs + 1), (places, n_places)))
        counts, count = count, count[:n_pairs]
        lefts[at:n_pairs], rights[at:n_pairs], count[at:] = ranked[head] >> wide, ranked[head] & ((1 << wide) - 1), times
        begins[at + 1 : n_pairs + 1] = filled + np.cumsum(times)
        places[filled:n_places] = fresh

        most = int(count.max()) if n_pairs else 0
        if most < min_count:
            break
        hit = np.flatnonzero(count >= max(min_count, most / fall))
        held = begins[hit + 1] - begins[hit]
        at = places[runs(begins[hit], held)]
        at = at[pair[at] == np.repeat(hit, held)]
        at.sort()
        # Among adjacent hits, every second one from the left is free of overlap.
        rank = np.arange(len(at))
        start = np.maximum.accumulate(np.where(np.append(True, after[at[:-1]] != at[1:]), rank, 0))
        at = at[(rank - start) % 2 == 0]
        used = np.bincount(pair[at], minlength=n_pairs)
        # A pair that overlaps left too few of waits for the next round, unless all wait.
        taken = used >= min_count if (used >= min_count).any() else used > 0
        at = at[taken[pair[at]]]
        made = np.stack([lefts[:n_pairs][taken], rights[:n_pairs][taken]], axis=1)
        rules.append(made)
        symbol = (len(length) + np.cumsum(taken) - 1).astype(np.int32)
        length = np.append(length, length[made[:, 0]] + length[made[:, 1]])
        right = after[at]
        follows = after[right]
        seq[at], last[at] = symbol[pair[at]], last[right]
        after[at], before[follows] = follows, at
        gone[right] = True
        beside = np.append(at, before[at])
        beside.sort()
        beside = beside[np.append(True, beside[1:] != beside[:-1])]
        changed = np.append(right, beside)
        lost = pair[changed]
        count -= np.bincount(lost[lost >= 0], minlength=n_pairs)
        pair[changed] = -1
        fresh = beside[~last[beside]]
    seq, last = seq[:n][~gone].astype(np.int64), last[:n][~gone]
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])
    table_ = np.concatenate(rules).astype(np.int64) if rules else np.zeros((0, 2), np.int64)
    return seq, table_, length[first:], starts


def pack(ids: np.ndarray, doc_len: np.ndarray, first: int) -> bytes:
    seq, rules, length, starts = compress(ids, doc_len, first)
    head = HEAD.pack(MAGIC, len(doc_len), len(rules), len(seq), first)
    return head + b"".join(x.astype("<u4").tobytes() for x in (doc_len, starts, rules.ravel(), length, seq))


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, blob: bytes):
        magic, n_docs, n_rules, n_seq, self.first = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        sizes = np.cumsum([0, n_docs, n_docs + 1, 2 * n_rules, n_rules, n_seq])
        flat = np.frombuffer(blob, "<u4", offset=HEAD.size)
        self.doc_len, self.starts, rules, length, self.seq = (flat[a:b].astype(np.int64) for a, b in zip(sizes, sizes[1:]))
        self.rules = rules.reshape(-1, 2)
        self.length = length

    def lengths(self, seq: np.ndarray) -> np.ndarray:
        if not len(self.length):
            return np.ones(len(seq), np.int64)
        return np.where(seq >= self.first, self.length[np.maximum(seq - self.first, 0)], 1)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        while len(at := np.flatnonzero(seq >= self.first)):
            n = np.ones(len(seq), np.int64)
            n[at] = 2
            place = np.cumsum(n) - n
            pair = self.rules[seq[at] - self.first]
            seq = np.repeat(seq, n)
            seq[place[at]], seq[place[at] + 1] = pair[:, 0], pair[:, 1]
        return seq.astype(np.uint32)

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rules in a row, where each rule's begin): rules of equal height are written at once, from lower ones."""
        start = np.cumsum(self.length) - self.length
        flat = np.zeros(int(self.length.sum()), np.uint32)
        left, right = self.rules.T
        height, known = np.zeros(self.first + len(self.rules), np.int64), None
        while known is None or (height[self.first :] != known).any():
            known = height[self.first :].copy()
            height[self.first :] = 1 + np.maximum(height[left], height[right])
        for level in range(1, int(height.max(initial=0)) + 1):
            rows = np.flatnonzero(known == level)
            for side, place in ((left[rows], start[rows]), (right[rows], start[rows] + self.lengths(left[rows]))):
                plain = side < self.first
                flat[place[plain]] = side[plain]
                rule = side[~plain] - self.first
                flat[runs(place[~plain], self.length[rule])] = flat[runs(start[rule], self.length[rule])]
        return flat, start

    def whole(self, seq: np.ndarray) -> np.ndarray:
        """What expand() gives, for long sequences: each rule is expanded once."""
        flat, start = self.expansions
        size = self.lengths(seq)
        rule = np.flatnonzero(seq >= self.first)
        out = np.repeat(seq.astype(np.uint32), size)
        held = seq[rule] - self.first
        out[runs((np.cumsum(size) - size)[rule], self.length[held])] = flat[runs(start[held], self.length[held])]
        return out

    def all(self) -> np.ndarray:
        return self.whole(self.seq)

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.starts[i] : self.starts[i + 1]])

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document i; expansion lengths tell which symbols to open."""
        seq = self.seq[self.starts[i] : self.starts[i + 1]]
        ends = np.cumsum(self.lengths(seq))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(seq[a:b])[start - before : stop - before]


def shards(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", target: int = 1 << 19) -> DataFrame:
    """(part, shard, before, n_ids, keys, payload): documents in key order, `target` ids a shard (one document at least)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, first = tokenizer_cache(tokenizer)
        part = TaskContext.get().partitionId()
        keys: list = []
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        shard = before = held = 0

        def out() -> pa.RecordBatch:
            blob = pack(np.concatenate(ids), np.concatenate(lens), first)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "before": before, "n_ids": held, "keys": list(keys), "payload": blob}], schema=arrow)

        for batch, texts in text_batches(batches, text):
            arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(batch.schema.field(key).type)), ("payload", pa.binary())])
            flat, count = cache.encode(texts)
            closed = np.insert(flat, np.cumsum(count), END_ID)
            keys += batch.column(key).to_pylist()
            ids.append(closed)
            lens.append(count + 1)
            held += len(closed)
            if held >= target:
                yield out()
                shard, before, held = shard + 1, before + held, 0
                keys, ids, lens = [], [], []
        if held:
            yield out()

    ordered = df.select(key, text).withColumn("_tie", F.xxhash64(text))
    ordered = ordered.repartitionByRange(key, "_tie").sortWithinPartitions(key, "_tie", text).drop("_tie")
    return arrow_map(ordered, run, f"part int, shard int, before bigint, n_ids bigint, keys array<{kind}>, payload binary")


def documents(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): each document's ids as little-endian 32-bit integers, read back from shards.

    The offset of a part is the sum of all ids in parts before it: one row a part, a few at any size.
    """
    kind = stored.schema["keys"].dataType.elementType.simpleString()
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before, keys, blob in zip(*(batch.column(c) for c in ("base", "before", "keys", "payload"))):
                shard = Shard(blob.as_buffer().to_pybytes())
                ends = np.cumsum(shard.doc_len)
                start = ends - shard.doc_len
                at = 0
                while at < len(ends):  # few shards are longer than one part
                    stop = max(at + 1, int(np.searchsorted(ends, start[at] + MOST_IDS, "right")))
                    ids = shard.whole(shard.seq[shard.starts[at] : shard.starts[stop]])
                    places = pa.array(np.append(0, ends[at:stop] - start[at]) * 4, pa.int32())
                    ids = pa.BinaryArray.from_buffers(pa.binary(), stop - at, [None, places.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([keys.values.slice(at, stop - at), pa.array(start[at:stop] + base.as_py() + before.as_py(), pa.int64()), ids], names=[key, "start", "ids"])
                    at = stop

    with_base = stored.join(F.broadcast(offsets), "part").select("base", "before", "keys", "payload")
    return arrow_map(with_base, run, f"{key} {kind}, start bigint, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "token_ids")
    stored = space.write(shards(table(spark, sf_dir, "documents"), tokenizer_path()), "shards")
    return documents(stored).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
