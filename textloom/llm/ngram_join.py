"""N-gram Jaccard join: all pairs of documents whose sets of five-word shingles are alike by 0.8 or more.

1. Each document's shingle set is hashed; documents with equal sets form a class of copies, of which
   only one text goes on as a node. MinHash signatures of the nodes are cut into bands; the numbers of
   bands and rows are chosen for the target recall at the threshold.
2. Band hashes are shuffled. Buckets with two nodes or more are kept; every pair of nodes that meets in
   a bucket is a candidate pair, and no other pair is.
3. Nodes are dealt into blocks, those with a bucket in common into the same block as far as it has
   room. A bucket whose nodes stand in several blocks makes each of its nodes meet the others' blocks.
   A unit of work is a block, or those nodes of two blocks that meet: exact intersections of full
   shingle sets come from one sparse incidence product. No pair is ever a row: a unit returns link
   counts per node and the few links that connect its nodes.
4. Those connecting links give classes: the connected components.

Words are runs of letters and digits of the lower-cased text. A document with one to four words has
one shingle, all its words. n_links counts the other documents (copies among them) alike by 0.8.

Texts are met by their MD5, never by the key, so keys may be null or repeat.

Defined results: a document without words (null, empty, only marks) has no shingles, links to nothing
and is its own class; rows that share a key are rows of their own, each with the class of its text; a
class is named by its least key, nulls aside (null if it has no other); other columns are not read, so
names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, lookup_skewed, sieved, table, text_batches

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Shingles and nodes of a block, on average: bounds a unit of work at twice these, or two documents.
BLOCK = 600_000
BLOCK_DOCS = 256


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band (fewest false candidates) that reach the recall at the threshold within the hashes."""
    for rows in range(most_hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall within so many hashes")


BANDS, ROWS = choose_bands()
_rng = np.random.default_rng(97)
MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = WordHashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = (s ^ h[i : i + n]) * _STEP
        s ^= s >> np.uint64(29)
    return np.unique(s)


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of the minimum-hash signature."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * MUL + ADD).min(axis=0), out=low)
    key = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _STEP
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketches(df: DataFrame) -> DataFrame:
    """(id, text_id, set_id, n, bands): digest and size of each row's shingle set and its band hashes; without words, no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            sets = [shingles(t) for t in texts]
            ids = [set_digest(s) if len(s) else None for s in sets]
            bands = [band_keys(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_id"), pa.array(ids, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_id", "set_id", "n", "bands"])
        _words.clear()  # workers live on: what a task has cached would add up over the stages of a job

    return arrow_map(df.select("id", "text", "text_id"), run, f"id {df.schema['id'].dataType.simpleString()}, text_id binary, set_id binary, n int, bands array<bigint>")


def node_sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): the shingle set of each wanted node (node, text_id), sorted 64-bit hashes in a row.

    A task sends a node once, however many copies of its text it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch, texts in text_batches(batches, "text"):
            found = {n: shingles(t).tobytes() for n, t in zip(batch.column("node").to_pylist(), texts) if n not in sent}
            sent.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(found.values(), pa.binary())], names=["node", "hashes"])
        _words.clear()

    maybe = sieved(df.select("text", "text_id"), F.xxhash64("text_id"), wanted, F.xxhash64("text_id")).filter("_maybe")
    rows = maybe.join(wanted, "text_id").select("node", "text")
    return arrow_map(rows, run, "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def local_forest(ties: DataFrame) -> DataFrame:
    """ties (a, b) → ties with the same components and a row for each node and partition at most.

    A node's ties meet in one partition, which joins its rows by union-find and sends each node with
    its root: connectivity, aggregated before anything is joined. Memory is that of a partition's nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                low, high = sorted((find(a), find(b)))
                root[high] = low
        found = [(x, r) for x in root if (r := find(x)) != x]
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([r for _, r in part], pa.binary())], names=["a", "b"])

    return arrow_map(ties.select("a", "b").repartition("a"), run, "a binary, b binary")


def components(edges: DataFrame, space: Workspace, label: str) -> DataFrame:
    """(node, root): the least node of each connected component. edges: (a, b).

    Every round, a node takes the least root around it, then the root of that root; a round's table
    is written to the shared folder, so lineage stays short and lost executors cost a task at most.
    Nodes that many others point to are met by broadcast, some 1000 rows at most (lookup_skewed).
    """
    links = space.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-links")
    degrees = space.write(links.groupBy("b").agg(F.count("*").alias("met")), f"{label}-degrees")
    roots = space.write(degrees.select(F.col("b").alias("node"), F.col("b").alias("root")), f"{label}-0")
    i = 0
    while True:
        around = degrees.join(roots.withColumnRenamed("node", "b"), "b")
        near = lookup_skewed(links, around, "b", "met").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        i += 1
        step = space.write(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "least").alias("mid")), f"{label}-step-{i}")
        heads = step.groupBy("mid").agg(F.count("*").alias("met")).join(roots.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid")
        moved = space.write(lookup_skewed(step, heads, "mid", "met").select("node", "old", F.least("mid", "far").alias("root")), f"{label}-{i}")
        space.drop(f"{label}-step-{i}")
        space.drop(f"{label}-{i - 1}")
        roots = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            space.drop(f"{label}-links")
            space.drop(f"{label}-degrees")
            return roots


def intersections(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Sizes of the intersections of the first n_left sets with all sets: an incidence product over the shingles that two sets share at least."""
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(columns, minlength=len(values)) > 1
    held = common[columns]
    rows, columns = rows[held], (np.cumsum(common) - 1)[columns[held]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((n_left, len(sets)), np.float32)
    width = max(1, (1 << 22) // len(sets))  # shingles in slices, so that the dense incidence stays small
    n = int(common.sum())
    for at in range(0, n, width):
        a, b = np.searchsorted(columns, [at, at + width])
        dense = np.zeros((len(sets), min(width, n - at)), np.float32)
        dense[rows[a:b], columns[a:b] - at] = 1
        total += dense[:n_left] @ dense.T
    return total


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Pairs of positions in left + right that are alike: across the sides, or within left if right is empty."""
    sets = left + right
    sizes = np.array([len(s) for s in sets], np.float64)
    inter = intersections(sets, len(left))
    found = inter >= THRESHOLD * (sizes[: len(left), None] + sizes - inter) - 1e-6
    if right:
        found[:, : len(left)] = False
    else:
        found = np.triu(found, 1)
    return np.argwhere(found)


def verify(units: DataFrame) -> DataFrame:
    """units: (low, high, side, node, copies, hashes) → (node, n, other): n links of node, and `other` a node it is tied to.

    A unit's rows come in any order; a unit is two blocks at most.
    """
    out = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("other", pa.binary())])

    def run(unit: pa.Table) -> pa.Table:
        rows = sorted(zip(*(unit.column(c).to_pylist() for c in ("side", "node", "copies", "hashes"))), key=lambda r: r[:2])
        order = [r[1] for r in rows]
        n_left = sum(r[0] == 0 for r in rows)
        crossed = unit.column("low")[0].as_py() != unit.column("high")[0].as_py()
        if len(rows) < 2 or crossed and n_left in (0, len(rows)):
            return out.empty_table()
        links = np.zeros(len(order), np.int64)
        root, size = list(range(len(order))), [1] * len(order)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        weight = np.array([r[2] for r in rows], np.int64)
        pairs = alike(sets[:n_left], sets[n_left:])
        np.add.at(links, pairs[:, 0], weight[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], weight[pairs[:, 0]])
        ties = []
        for i, j in pairs.tolist():
            a, b = find(i), find(j)
            if a != b:
                # The end in the smaller part goes first, so that few ties begin at one node.
                if size[a] > size[b]:
                    (a, i), (b, j) = (b, j), (a, i)
                root[a] = b
                size[b] += size[a]
                ties.append((order[i], 0, order[j]))
        found = [(order[i], int(links[i]), None) for i in np.flatnonzero(links)] + ties
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out) if found else out.empty_table()

    return units.groupBy("low", "high").applyInArrow(run, "node binary, n long, other binary")


def candidate_units(nodes: DataFrame, space: Workspace) -> DataFrame:
    """(node, low, high, side): which nodes (node, n, bands) meet in which unit; low = high for a block by itself."""
    buckets = space.write(nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket")), "buckets")
    heads = space.write(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "heads")
    shared = space.write(lookup_skewed(buckets, heads, "bucket", "size"), "shared")
    space.drop("buckets")

    # A node's home is the least bucket of the nodes it shares a bucket with, so near copies have one home.
    own = shared.groupBy("node").agg(F.min("bucket").alias("home"))
    label = shared.join(own, "node").groupBy("bucket").agg(F.count("*").alias("size"), F.min("home").alias("home"))
    homes = lookup_skewed(shared, space.write(label, "labels"), "bucket", "size").groupBy("node").agg(F.min("home").alias("home"))
    homes = space.write(homes.join(nodes.select("node", "n"), "node"), "homes")

    # Enough blocks for each home that none holds over BLOCK shingles or BLOCK_DOCS nodes, on average.
    sized = homes.groupBy("home").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = sized.select("home", "docs", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK), F.lit(1)).alias("blocks"))
    dealt = lookup_skewed(homes.select("node", "home"), space.write(blocks, "blocks"), "home", "docs")
    dealt = space.write(dealt.select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")), "dealt")

    # Where a bucket's nodes stand in several blocks, each of them meets the others' blocks.
    spans = shared.join(dealt, "node").groupBy("bucket").agg(F.count("*").alias("size"), F.collect_set("block").alias("met")).filter(F.size("met") > 1)
    met = lookup_skewed(shared, space.write(spans, "spans"), "bucket", "size").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    placed = dealt.join(met, "node", "left").select("node", "block", F.explode(F.array_union(F.array("block"), F.coalesce("met", F.array().cast("array<bigint>")))).alias("met"))
    return placed.select("node", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), (F.col("block") > F.col("met")).cast("int").alias("side"))


def classify(df: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """df: (id, text, text_id) → (rows (id, text_id, set_id), sets (set_id, copies, root, class_id, n_links))."""
    marks = space.write(sketches(df), "marks")
    worded = marks.filter("set_id is not null")
    nodes = worded.groupBy(F.col("set_id").alias("node")).agg(F.min("id").alias("rep"), F.min("text_id").alias("text_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = space.write(nodes, "nodes")

    placed = space.write(candidate_units(nodes, space), "placed")
    wanted = space.write(nodes.select("node", "text_id").join(placed.filter("low = high").select("node"), "node", "left_semi"), "wanted")
    sets = space.write(node_sets(df, wanted), "sets")
    units = placed.join(sets, "node").join(nodes.select("node", "copies"), "node").select("low", "high", "side", "node", "copies", "hashes")
    found = space.write(verify(units), "found")
    for name in ("heads", "shared", "labels", "homes", "blocks", "dealt", "spans", "placed", "wanted", "sets"):
        space.drop(name)

    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    tied = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = components(local_forest(tied), space, "classes")
    named = nodes.select("node", "rep", "copies").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = space.write(named.select("node", "rep", "copies", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = space.write(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("nodes")), "least")
    known = lookup_skewed(named, least, "root", "nodes").select(F.col("node").alias("set_id"), "copies", "root", "class_id", "n_links")
    return marks.select("id", "text_id", "set_id"), space.write(known, "known")


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("id"), body.alias("text"), F.unhex(F.md5(body)).alias("text_id"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", space: Workspace | None = None) -> DataFrame:
    """(key, class_id, n_links) for every row."""
    rows, sets = classify(texts_of(df, key, text), space or Workspace(df.sparkSession, "ngram_join"))
    linked = lookup_skewed(rows.filter("set_id is not null").select("id", "set_id"), sets, "set_id", "copies").select("id", "class_id", "n_links")
    alone = rows.filter("set_id is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumnRenamed("id", key)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", space: Workspace | None = None) -> DataFrame:
    """The rows of df without near duplicates: of each class the row of least key (a null counts as the greatest).

    Ties go by the texts' MD5, then by the other columns. Rows without words have no class and all stay.
    """
    space = space or Workspace(df.sparkSession, "ngram_join")
    rows, sets = classify(texts_of(df, key, text), space)
    classed = lookup_skewed(rows.filter("set_id is not null"), sets, "set_id", "copies").groupBy("root", "id", "text_id").agg(F.count("*").alias("rows"))
    classed = space.write(classed, "classed")
    best = classed.groupBy("root").agg(F.count("*").alias("all"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_id")).alias("best"))
    # What is to be done with some row: pairs of key and text to drop, and those of which one row of many stays.
    beaten = lookup_skewed(classed, space.write(best.select("root", "all", "best.id", "best.text_id").withColumnsRenamed({"id": "best_id", "text_id": "best_text"}).filter("all > 1"), "best"), "root", "all")
    beaten = beaten.filter(~(F.col("id").eqNullSafe(F.col("best_id")) & (F.col("text_id") == F.col("best_text")))).select("id", "text_id", F.lit(True).alias("dropped"))
    twice = classed.filter("rows > 1").select("id", "text_id", F.lit(False).alias("dropped"))
    touched = space.write(beaten.unionByName(twice).groupBy("id", "text_id").agg(F.max("dropped").alias("dropped")), "touched")
    touched = touched.select(F.col("id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("dropped").alias("_dropped"))

    body = df.withColumn("_text_id", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    marked = sieved(body, F.xxhash64(F.col(key), "_text_id"), touched, F.xxhash64("_id", "_text_id"))
    met = marked.filter("_maybe").withColumnRenamed("_text_id", "_own").join(touched, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text_id")), "left")
    one = met.filter("_dropped = false").groupBy("_id", "_text_id").agg(F.min(F.struct(*df.columns)).alias("_row")).select("_row.*")
    return marked.filter("not _maybe").select(*df.columns).unionByName(met.filter("_dropped is null").select(*df.columns)).unionByName(one)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle, in full: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 0.000001
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT doc_id, (SELECT min(root) FROM r WHERE node = doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links FROM documents
"""
