"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set are its distinct word shingles, as 64-bit hashes. One fixed
permutation spreads the shingles over a universe of 2**20; coordinate k of the
signature is the least value that a second permutation, shifted circularly by k,
gives them. Documents with equal sets are one class, its node the least id. Nodes
that agree in all rows of a band are candidates of each other.

The candidates of a band's bucket need no list of pairs: each bucket has a hub,
its least node. First every node is held against the least of its hubs. The
components of the links so found leave, in each hub's group, those nodes that
aren't in the hub's component; these are held against all nodes of the group, in
blocks of bounded size, as only they can have a link that still joins something.
So no link between different components is missed among the candidates, and a
group of copies costs about its size. All decisions are made on full sets.

A pair with a similarity of exactly 0.8 escapes all 32 bands of 5 rows with a
probability of 3e-6; a higher one with less.

Defined results: a null text, one without words and one with an empty set is
linked with nothing; fewer words than a shingle has are one shingle; equal sets
are linked; rows that share an id are one document, linked through it; a row with
a null id is linked with nothing, its component is null and it is kept; an empty
table gives no rows. Columns that the operator doesn't use may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import segment_sums
from .graph import components
from .memory import tidy
from .storage import materialise

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 5
BLOCK_ELEMENTS = 1 << 21
SIFT = 1 << 20  # most rows that are broadcast

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_table: np.ndarray | None = None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``width`` words."""
    raw = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)  # lower() of bytes: A to Z only
    word = ~_SPACE[raw]
    edges = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = _mix(segment_sums(raw, starts, ends) + (ends - starts).astype(np.uint64))
    n = max(1, len(words) - width + 1)
    found = np.full(n, min(len(words), width), dtype=np.uint64)
    for k in range(min(len(words), width)):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(found)


def _permutation(coordinates: int) -> np.ndarray:
    """Windows on a permutation of the universe that goes round: row i has its shifts at i."""
    global _table
    if _table is None or len(_table) < UNIVERSE + coordinates:
        order = np.random.default_rng(5).permutation(UNIVERSE).astype(np.uint32)
        _table = np.concatenate((order, order[:coordinates]))
    return np.lib.stride_tricks.sliding_window_view(_table, coordinates)


def signature(found: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates from two permutations: the hashes' spread over the universe, and a table's shifts."""
    table = _permutation(coordinates)
    places = (_mix(found ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, UNIVERSE, dtype=np.uint32)
    for k in range(0, len(places), 1024):
        np.minimum(out, table[places[k : k + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= 80 * (a + b - common)


def _sign(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(signature(found)) if len(found) else None)
            columns = [batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """docs: node, hub, first, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column("text")]
            columns = [*batch.columns[:3], pa.array([len(s) for s in found], type=pa.int64()), pa.array([s.tobytes() for s in found], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hub", "first", "n", "shingles"])

    return docs.mapInArrow(tidy(run), "node long, hub long, first boolean, n long, shingles binary")


def _verify(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, left, right (sets). Keeps those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                keep.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.mapInArrow(tidy(run), "a long, b long")


def links_in_block(nodes: np.ndarray, labels: np.ndarray, rest: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different labels with a node of the rest; as many as join labels that no earlier link joins."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, group = [], labels.copy()
    for i in np.flatnonzero(rest):
        if not (group != group[i]).any():
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], starts[:-1])
        mark[own] = 0
        for j in np.flatnonzero(similar(common, sizes, sizes[i]) & (group != group[i])):
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
        if links:
            group = np.array([root(int(x)) for x in labels])
    return links


def _links_in_blocks(rows: DataFrame) -> DataFrame:
    """rows: hub, i, j, node, label, rest, shingles. A block has a bounded number of shingles."""

    def run(table: pa.Table) -> pa.Table:
        by_node: dict[int, tuple] = {}  # a node of the rest may come as a member too
        for node, label, rest, data in zip(*(table.column(c).to_pylist() for c in ("node", "label", "rest", "shingles")), strict=True):
            if rest or (node, data) not in by_node:
                by_node[node, data] = (node, label, rest, np.frombuffer(data, dtype=np.uint64))
        nodes, labels, rest, sets = zip(*by_node.values(), strict=True)
        links = links_in_block(np.array(nodes), np.array(labels), np.array(rest), list(sets))
        return pa.table({"a": pa.array([min(x) for x in links], type=pa.int64()), "b": pa.array([max(x) for x in links], type=pa.int64())})

    return rows.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs: doc_id (integer), text. Returns doc_id, n_shingles, component_id and kept, a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(_sign(docs, width), "signed")
    full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialise(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where(F.col("hub") < F.col("last")).select("key", "hub")
    stars = materialise(banded.join(hubs, "key").where(F.col("node") > F.col("hub")).select("node", "hub").distinct(), "stars")

    own = stars.groupBy("node").agg(F.min("hub").alias("hub"))
    # first: the least hub of some node.
    as_hub = lambda df, first: df.select(F.col("hub").alias("node"), F.lit(None).cast("long").alias("hub"), F.lit(first).alias("first"))
    wanted = own.withColumn("first", F.lit(False)).unionByName(as_hub(own, True)).unionByName(as_hub(stars, False))
    wanted = wanted.groupBy("node").agg(F.min("hub").alias("hub"), F.max("first").alias("first"))
    wanted = materialise(wanted, "wanted")
    sieve = wanted.select(F.pmod(F.xxhash64("node"), F.lit(SIFT)).alias("place")).distinct()
    texts = docs.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(SIFT))).join(F.broadcast(sieve), "place", "left_semi")
    texts = texts.join(wanted, F.col("doc_id") == F.col("node")).select("node", "hub", "first", "text")
    sets = materialise(_sets(texts, width), "sets")

    # Both sides are tables, so that Spark can split a large hub's rows.
    hub_sets = sets.where("first").select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    pairs = sets.where(F.col("hub").isNotNull()).select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("shingles").alias("right"))
    first = materialise(_verify(pairs.join(hub_sets, "a").select("a", "b", "left", "right")), "links")

    labels = materialise(_labels(sets, first), "labels")
    groups = stars.join(labels.withColumnRenamed("label", "hub_label").withColumnRenamed("node", "l_node"), F.col("hub") == F.col("l_node")).drop("l_node")
    groups = groups.join(labels, "node").join(own.select("node", F.col("hub").alias("first_hub")), "node")
    groups = groups.withColumn("rest", F.col("label") != F.col("hub_label"))
    sizes = sets.groupBy("node").agg(F.max("n").alias("n"))
    members = groups.select("hub", "node", "label", "rest", (F.col("hub") == F.col("first_hub")).alias("seen"))
    members = materialise(members.join(sizes, "node"), "members")
    counts = members.groupBy("hub").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("rest"), F.col("n"))), F.lit(0)).alias("rest_total"),
        F.count("*").alias("many"), F.min("seen").alias("all_seen"),
    )
    # A group of a hub and one node that it has been held against has nothing left to compare.
    counts = counts.where((F.col("rest_total") > 0) & ~((F.col("many") == 1) & F.col("all_seen")))
    part = lambda total, size: F.ceil(F.col(total) / size).cast("int")
    # Members lie in smaller blocks where the copies of the rest that this takes are no more than the members.
    finer = F.least(part("total", max(1, BLOCK_ELEMENTS // 32)), F.ceil(F.col("total") / F.col("rest_total")).cast("int"))
    counts = counts.select("hub", F.greatest(part("total", BLOCK_ELEMENTS), finer).alias("jn"), part("rest_total", BLOCK_ELEMENTS).alias("in"))
    hub_rows = counts.join(labels, F.col("hub") == F.col("node")).select("hub", "node", "label", F.lit(False).alias("rest"), "jn", "in")
    rows = members.join(counts, "hub").select("hub", "node", "label", "rest", "jn", "in").unionByName(hub_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    as_member = rows.select("hub", every("in").alias("i"), spread("jn").alias("j"), "node", "label", F.lit(False).alias("rest"))
    as_rest = rows.where("rest").select("hub", spread("in").alias("i"), every("jn").alias("j"), "node", "label", "rest")
    tasks = as_member.unionByName(as_rest).join(sets.select("node", "shingles"), "node")
    second = materialise(_links_in_blocks(tasks), "links")

    found = components(first.unionByName(second))
    named = full.select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    # Ids that rows with different texts share link those rows' classes: the class that the id names, and others.
    others = named.where(F.col("doc_id") != F.col("node"))
    shared = others.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") < F.col("b")).select("a", "b")
    named_by = others.select("doc_id", F.col("node").alias("a")).join(classes.select(F.col("node").alias("b")), F.col("doc_id") == F.col("b")).select("a", "b")
    shared = materialise(shared.unionByName(named_by), "shared")
    if not shared.isEmpty():
        found = components(first.unionByName(second).unionByName(shared))
    by_node = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(by_node, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    return sets.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all documents, over shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
