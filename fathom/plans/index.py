"""The inverted index as tables.

``postings`` (term, docid, tf, doc_len, positions) is grouped by term and
document; the document's length stands beside each posting, so that scoring joins
no second table. ``term_stats`` (term, df, cf, idf), ``doc_stats`` (docid,
doc_len), ``stats`` (one row) and ``doc_vectors`` (docid, terms) go with it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.functions.ranges import number
from fathom.functions.tokenize import tokens

DF_CUTOFF = 9
SIFT = 1 << 20  # most rows that are broadcast
TYPES = ("docids", "tf", "positional")
#: Tokens whose postings are made at once; one document's at least.
TOKENS = 1 << 18
#: About as many tokens are behind the postings of one file, and so many postings a file are looked at for where files begin.
PART, LOOKS = 1 << 20, 200
#: Most rows that are handed on at once.
ROWS = 1 << 16


@dataclass(frozen=True)
class Index:
    """Tables of an index. ``df_cutoff``: only terms in more documents than that can be searched for."""

    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    stats: DataFrame
    doc_vectors: DataFrame | None
    index_type: str = "positional"
    df_cutoff: int = DF_CUTOFF
    reverse: bool = False
    #: Where the postings were loaded from, those postings and their order.
    saved: tuple[str, DataFrame, bool] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def need(self, column: str) -> None:
        if column not in self.postings.columns:
            raise ValueError(f"this query needs {column}; the index is of type {self.index_type}")

    def searchable(self) -> DataFrame:
        return self.term_stats.where(F.col("df") > self.df_cutoff)

    def newest_first(self) -> Column:
        """How documents are ordered when nothing else decides."""
        return F.col("docid").desc() if self.reverse else F.col("docid").asc()


def tokenized(docs: DataFrame, docid: Column, text: Column) -> DataFrame:
    """docid, terms: the document vectors. Of rows that share an id, one is taken, whichever text sorts first."""
    rows = docs.select(docid.cast("long").alias("docid"), text.alias("text")).withColumn("place", F.pmod(F.xxhash64("docid"), F.lit(SIFT)))
    # Only rows in a repeated id's place are grouped, so that other texts needn't move; a row without an id shares it with no other.
    repeated = rows.where(F.col("docid").isNotNull()).groupBy("docid", "place").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sieve = F.broadcast(repeated.select("place").distinct())
    placed = rows.withColumn("place", F.when(F.col("docid").isNotNull(), F.col("place")))
    single = placed.join(sieve, "place", "left_anti").select("docid", "text")
    one = placed.join(sieve, "place", "left_semi").groupBy("docid").agg(F.min("text").alias("text"))
    return single.unionByName(one).select("docid", tokens(F.col("text")).alias("terms"))


def collection_stats(doc_stats: DataFrame) -> DataFrame:
    sums = doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    s = sums.withColumn("avgdl", F.try_divide(F.col("total_len").cast("double"), F.col("n_docs").cast("double")))
    s = s.withColumn("default_df", F.floor(F.col("n_docs") / 100).cast("long"))
    s = s.withColumn("default_cf", 2 * F.col("default_df"))
    return s.withColumn("default_idf", scoring.idf(F.col("default_df"), F.col("n_docs")))


def _grouped(with_positions: bool):
    """Rows of docid, terms into those of term, docid, tf, doc_len and, if wanted, positions. A document's postings are made from its one row."""

    def of(ids: pa.Array, lists: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded, n = lists.flatten().dictionary_encode(null_encoding="encode"), len(sizes)
        key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        order = np.argsort(key, kind="stable")  # by term, document and position
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bounds, doc = np.append(starts, len(key)).astype(np.int32), key[starts] % n
        made = {"term": coded.dictionary.take(pa.array(key[starts] // n)), "docid": ids.take(pa.array(doc)), "tf": pa.array(np.diff(bounds)), "doc_len": pa.array(sizes[doc])}
        if with_positions:
            at = np.arange(1, len(key) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            made["positions"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at[order].astype(np.int32)))
        return pa.RecordBatch.from_pydict(made)

    return _by_tokens(of)


def _by_tokens(of):
    """Hands ids, terms and their numbers to a function, as many documents at once as have TOKENS tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("docid"), batch.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(before, before[at] + TOKENS, side="right")) - 1)
                if before[to] > before[at]:
                    yield of(ids.slice(at, to - at), lists.slice(at, to - at), sizes[at:to])
                at = to

    return run


# Functions that tasks run are made within others, so that they are sent whole: executors needn't have this module.


def _packing():
    """Postings as they move: each of terms stands for so many postings in a row, as runs tells; known: which have an id, if some have none."""
    whole = lambda values: None if values is None else np.ascontiguousarray(values, dtype=np.int32).tobytes()

    def pack(terms: list, runs: np.ndarray, docid: np.ndarray, known: np.ndarray | None, tf: np.ndarray, doc_len: np.ndarray, positions: np.ndarray | None) -> bytes:
        return pickle.dumps((terms, whole(runs), docid.astype(np.int64).tobytes(), whole(known), whole(tf), whole(doc_len), whole(positions)), protocol=5)

    return pack


def _blocks(bounds: list[tuple[str, int]], with_positions: bool, reverse: bool = False):
    """Rows of docid, terms into those of part and block: a part's postings of some documents, in order of terms and documents. Bounds are the parts' first postings."""
    names, ids, pack = np.array([t for t, _ in bounds], dtype=object), np.array([d for _, d in bounds], dtype=np.int64), _packing()

    def of(docids: pa.Array, lists: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded, docids, n = lists.flatten().dictionary_encode(null_encoding="encode"), docids.to_numpy(), len(sizes)
        by_name = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        terms, m = coded.dictionary.take(by_name).to_pylist(), len(coded.dictionary)
        as_ordered = ~docids if reverse else docids
        rank, by_id, place = np.empty(m, dtype=np.int64), np.argsort(as_ordered, kind="stable"), np.empty(n, dtype=np.int64)
        rank[by_name.to_numpy()], place[by_id] = np.arange(m), np.arange(n)
        key = rank[coded.indices.to_numpy()] * n + np.repeat(place, sizes)
        order = np.argsort(key, kind="stable")  # by term, document and position
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends, code, doc = np.append(starts, len(key)), key[starts] // n, by_id[key[starts] % n]
        docid, doc_len, tf, of_term = docids[doc], sizes[doc], np.diff(ends), np.searchsorted(key[starts] // n, np.arange(m + 1))
        at = (np.arange(1, len(key) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype(np.int32) if with_positions else None
        # Where the parts begin; terms in which some do are cut by document.
        sortable = np.array([t or "" for t in terms] + [None], dtype=object)[:-1]
        first = np.searchsorted(sortable, names, side="left") if len(names) else np.zeros(0, dtype=np.int64)
        cuts = of_term[first]
        for k in np.flatnonzero(first < m):
            if sortable[first[k]] == names[k]:
                a, b = of_term[first[k]], of_term[first[k] + 1]
                cuts[k] = a + np.searchsorted(as_ordered[doc[a:b]], ids[k], side="left")
        edges, parts, made = np.concatenate([[0], cuts, [len(starts)]]), [], []
        for part in np.flatnonzero(np.diff(edges)):
            a, b = edges[part], edges[part + 1]
            heads = np.flatnonzero(np.concatenate([[True], code[a + 1 : b] != code[a : b - 1]]))
            held = [terms[c] for c in code[a + heads]]
            made.append(pack(held, np.diff(np.append(heads, b - a)), docid[a:b], None, tf[a:b], doc_len[a:b], at[ends[a] : ends[b]] if with_positions else None))
            parts.append(part)
        return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "block": pa.array(made, pa.binary())})

    return _by_tokens(of)


def _loose_blocks(bounds: list[tuple[str, int]], with_positions: bool, reverse: bool = False):
    """Rows of term, docid, tf, doc_len and, if wanted, positions into those of part and block."""
    dealt, pack = _dealt(bounds, reverse), _packing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in dealt(batches):
            part, parts, made = batch.column("part").to_numpy(), [], []
            for p in np.unique(part):
                rows = batch.take(pa.array(np.flatnonzero(part == p)))
                docid, n = rows.column("docid"), rows.num_rows
                known = docid.is_valid().to_numpy(zero_copy_only=False) if docid.null_count else None
                at = rows.column("positions").flatten().to_numpy() if with_positions else None
                tf, doc_len = rows.column("tf").to_numpy(), rows.column("doc_len").to_numpy()
                made.append(pack(rows.column("term").to_pylist(), np.ones(n), pc.fill_null(docid, 0).to_numpy(), known, tf, doc_len, at))
                parts.append(p)
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "block": pa.array(made, pa.binary())})

    return run


def _unpacked(columns: list[str], reverse: bool):
    """Rows of part and block, in order of parts, into postings in order of terms and documents. A part's are held at once."""

    def merged(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        whole = lambda k, kind=np.int32: np.concatenate([np.frombuffer(b[k], dtype=kind) for b in blocks])
        coded = pa.array(list(chain.from_iterable(b[0] for b in blocks)), pa.string()).dictionary_encode(null_encoding="encode")
        by_name = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        rank = np.empty(len(coded.dictionary), dtype=np.int64)
        rank[by_name.to_numpy()] = np.arange(len(rank))
        code, docid, tf, doc_len = np.repeat(rank[coded.indices.to_numpy()], whole(1)), whole(2, np.int64), whole(4), whole(5)
        known = np.concatenate([np.ones(len(b[2]) // 8, dtype=bool) if b[3] is None else np.frombuffer(b[3], dtype=np.int32) > 0 for b in blocks])
        # What has no id is first in order of ids.
        order = np.lexsort((~docid if reverse else docid, known != reverse, code))
        starts, tf = (np.cumsum(tf, dtype=np.int64) - tf)[order], tf[order]
        ends = np.concatenate([[0], np.cumsum(tf, dtype=np.int64)])
        at = whole(6) if "positions" in columns else None
        terms = coded.dictionary.take(by_name)
        for a in range(0, len(order), ROWS):
            b = min(a + ROWS, len(order))
            rows = order[a:b]
            made = {"term": terms.take(pa.array(code[rows])), "docid": pa.array(docid[rows], mask=~known[rows]), "tf": pa.array(tf[a:b]), "doc_len": pa.array(doc_len[rows].astype(np.int64))}
            if at is not None:
                places = np.repeat(starts[a:b] - (ends[a:b] - ends[a]), tf[a:b]) + np.arange(ends[b] - ends[a])
                made["positions"] = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(at[places]))
            yield pa.RecordBatch.from_pydict({c: made[c] for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for part, block in zip(batch.column("part").to_numpy(), batch.column("block")):
                if part != now and blocks:
                    yield from merged(blocks)
                    blocks = []
                now = part
                blocks.append(pickle.loads(block.as_buffer()))
        if blocks:
            yield from merged(blocks)

    return run


def _postings(vectors: DataFrame, with_positions: bool, bounds: list[tuple[str, int]] | None = None, reverse: bool = False) -> DataFrame:
    """term, docid, tf, doc_len and, if wanted, positions; with bounds, blocks of them and the parts that they belong to.

    Nothing is shuffled but the ids: only rows that share one, or have none, are
    grouped over all documents.
    """
    placed = vectors.select("docid", "terms", F.coalesce(F.pmod(F.xxhash64("docid"), F.lit(SIFT)), F.lit(0)).alias("place"))
    shared = placed.groupBy("docid", "place").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("docid").isNull())
    sieve = F.broadcast(shared.select("place").distinct())
    kinds = "term string, docid long, tf int, doc_len long" + (", positions array<int>" if with_positions else "")
    packed = "part int, block binary"
    single = placed.join(sieve, "place", "left_anti").select("docid", "terms")
    single = single.mapInArrow(_grouped(with_positions), kinds) if bounds is None else single.mapInArrow(_blocks(bounds, with_positions, reverse), packed)
    several = placed.join(sieve, "place", "left_semi").select("docid", F.size("terms").cast("long").alias("doc_len"), F.posexplode("terms").alias("at", "term"))
    counts = several.groupBy("term", "docid").agg(
        F.count("*").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"), F.sort_array(F.collect_list((F.col("at") + 1).cast("int"))).alias("positions")
    )
    counts = counts if with_positions else counts.drop("positions")
    return single.unionByName(counts if bounds is None else counts.mapInArrow(_loose_blocks(bounds, with_positions, reverse), packed))


def _bounds(postings: DataFrame, n: int, total: int, reverse: bool = False) -> list[tuple[str, int]]:
    """The first term and document (inverted if the order is) of each part but the first, so that they are about as large. Only how even they are depends on the postings looked at."""
    few = max(1, total // (n * LOOKS))
    seen = postings.select("term", "docid").where(F.col("term").isNotNull() & F.col("docid").isNotNull() & (F.pmod(F.xxhash64("term", "docid"), F.lit(few)) == 0))
    rows = sorted((t, ~d if reverse else d) for t, d in seen.collect())
    return sorted({rows[len(rows) * k // n] for k in range(1, n)} if rows else ())


def _dealt(bounds: list[tuple[str, int]], reverse: bool = False):
    """Adds part: the number of the part that a posting belongs to."""
    names, ids = np.array([t for t, _ in bounds], dtype=object), np.array([d for _, d in bounds], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("term").dictionary_encode(null_encoding="encode")
            terms, code = np.array([t or "" for t in coded.dictionary.to_pylist()], dtype=object), coded.indices.to_numpy()
            low, high = np.searchsorted(names, terms, side="left"), np.searchsorted(names, terms, side="right")
            part = low[code] if len(terms) else np.zeros(0, dtype=np.int64)
            cut = np.flatnonzero((low < high)[code]) if len(terms) else part
            if len(cut):  # terms in which parts begin
                docid = pc.fill_null(batch.column("docid"), np.iinfo(np.int64).min).to_numpy()
                docid = ~docid if reverse else docid
                cut = cut[np.argsort(code[cut], kind="stable")]
                for rows in np.split(cut, np.flatnonzero(np.diff(code[cut])) + 1):
                    a, b = low[code[rows[0]]], high[code[rows[0]]]
                    part[rows] = a + np.searchsorted(ids[a:b], docid[rows], side="right")
            yield batch.append_column("part", pa.array(part.astype(np.int32)))

    return run


def build_index(
    vectors: DataFrame, index_type: str = "positional", df_cutoff: int = DF_CUTOFF, reverse: bool = False, with_vectors: bool = True
) -> Index:
    """vectors: docid (unique), terms. Nothing runs before the tables are used or saved."""
    if index_type not in TYPES:
        raise ValueError(f"index_type must be one of {TYPES}")
    if df_cutoff < 0:
        raise ValueError("df_cutoff must not be negative")
    counts = _postings(vectors, index_type == "positional")
    keep = {"docids": ["term", "docid", "doc_len"], "tf": ["term", "docid", "tf", "doc_len"], "positional": ["term", "docid", "tf", "doc_len", "positions"]}
    doc_stats = vectors.select("docid", F.size("terms").cast("long").alias("doc_len"))
    stats = collection_stats(doc_stats)
    return Index(
        counts.select(*keep[index_type]), term_stats(counts, stats), doc_stats, stats, vectors if with_vectors else None, index_type, df_cutoff, reverse
    )


def term_stats(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """df, cf and idf of each term, and the (tf, doc_len) with the largest BM25 weight, ties to the larger."""
    part = scoring.bm25_tf(F.col("tf"), F.col("doc_len"), F.col("avgdl"))
    weighed = postings.crossJoin(F.broadcast(stats.select("avgdl", "n_docs"))).withColumn("weight", F.round(part, 9))
    t = weighed.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), F.max(F.struct("weight", "tf", "doc_len")).alias("top"), F.first("n_docs").alias("n_docs")
    )
    return t.select("term", "df", "cf", scoring.idf(F.col("df"), F.col("n_docs")).alias("idf"), F.col("top.tf").alias("max_tf"), F.col("top.doc_len").alias("max_tf_dl"))


def dictionary(vectors: DataFrame) -> DataFrame:
    """termid, term: numbered from 0 in the order in which terms are first seen.

    Terms are numbered in ranges of documents with about as many new terms each, so
    no task sorts all terms.
    """
    found = vectors.select("docid", F.posexplode("terms").alias("pos", "term"))
    first = found.groupBy("term").agg(F.min(F.struct("docid", "pos")).alias("at")).select("term", "at.docid", "at.pos")
    return number(first, "docid", "pos").select((F.col("at") - 1).alias("termid"), "term")


def _parts(stats: DataFrame, partitions: int | None) -> int:
    return partitions or (stats.first().total_len or 0) // PART + 1


def _write_postings(dealt: DataFrame, reverse: bool, path: str) -> None:
    """Postings (dealt by ranges) are ordered by term and document over all files, so a term's are found by the files' statistics."""
    order = F.col("docid").desc() if reverse else F.col("docid").asc()
    dealt.sortWithinPartitions("term", order).write.mode("overwrite").parquet(f"{path}/postings")


def _write_meta(index: Index, path: str) -> None:
    row = [(index.index_type, index.df_cutoff, index.reverse, index.doc_vectors is not None)]
    index.spark.createDataFrame(row, "index_type string, df_cutoff int, reverse boolean, vectors boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def create_index(
    vectors: DataFrame, path: str, index_type: str = "positional", df_cutoff: int = DF_CUTOFF, reverse: bool = False, with_vectors: bool = True,
    partitions: int | None = None,
) -> Index:
    """Builds and saves an index. vectors (docid, terms) is read once; each table is made of those that are written before it."""
    spark, kept = vectors.sparkSession, f"{path}/{'doc_vectors' if with_vectors else '_vectors'}"
    vectors.select("docid", "terms").write.mode("overwrite").parquet(kept)
    built = build_index(spark.read.schema("docid long, terms array<string>").parquet(kept), index_type, df_cutoff, reverse, with_vectors)
    built.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    collection_stats(spark.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    n, saved = _parts(stats, partitions), spark.read.schema("docid long, terms array<string>").parquet(kept)
    # Where parts begin is told by some documents' terms; a file has several if fewer files are wanted, so that a task holds one part however long its file is.
    total = stats.first().total_len
    each = -(-_parts(stats, None) // n)
    few = max(1, total // (n * each * LOOKS * 100))
    some = saved.where(F.pmod(F.xxhash64("docid"), F.lit(few)) == 0).select("docid", F.explode(F.array_distinct("terms")).alias("term"))
    blocks = _postings(saved, index_type == "positional", _bounds(some, n * each, total // few, reverse), reverse)
    blocks = blocks.repartitionById(n, F.floor(F.col("part") / each).cast("int")).sortWithinPartitions("part")
    columns = built.postings.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in built.postings.schema)
    blocks.mapInArrow(_unpacked(columns, reverse), kinds).write.mode("overwrite").parquet(f"{path}/postings")
    # Without term frequencies in the postings the statistics count the vectors again.
    terms = built.term_stats if index_type == "docids" else term_stats(spark.read.parquet(f"{path}/postings"), stats)
    terms.write.mode("overwrite").parquet(f"{path}/term_stats")
    _write_meta(built, path)
    if not with_vectors:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return load_index(spark, path)


def _ordered_files(index: Index) -> int:
    """How many files hold the postings, if these are as they were saved; else 0."""
    as_saved = index.saved is not None and index.postings is index.saved[1] and index.reverse == index.saved[2]
    return len(index.postings.inputFiles()) if as_saved else 0


def _each_file(spark: SparkSession) -> SparkSession:
    """A session like the given one whose tasks read a whole file each."""
    other = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name in ("maxPartitionBytes", "openCostInBytes"):
        other.conf.set(f"spark.sql.files.{name}", str(1 << 40))
    other.conf.unset("spark.sql.files.maxPartitionNum")
    return other


def save_index(index: Index, path: str, partitions: int | None = None) -> None:
    """Writes the tables of an index that are tables already; see ``create_index`` for a new one.

    Saved postings are in order already: if their files are about as many as are
    wanted, each is rewritten by a task of its own and nothing is shuffled or sorted.
    """
    n, files = _parts(index.stats, partitions), _ordered_files(index)
    if files == n if partitions else n <= 2 * files <= 4 * n:
        _each_file(index.spark).read.schema(index.postings.schema).parquet(f"{index.saved[0]}/postings").write.mode("overwrite").parquet(f"{path}/postings")
    else:
        _write_postings(index.postings.repartitionByRange(n, "term", "docid"), index.reverse, path)
    for name in ("term_stats", "doc_stats", "stats", "doc_vectors"):
        if (table := getattr(index, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    _write_meta(index, path)


def load_index(spark: SparkSession, path: str) -> Index:
    kind, cutoff, reverse, vectors = spark.read.parquet(f"{path}/meta").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    postings = read("postings")
    saved = path, postings, reverse
    return Index(postings, read("term_stats"), read("doc_stats"), read("stats"), read("doc_vectors") if vectors else None, kind, cutoff, reverse, saved)


def compact(spark: SparkSession, source: str, target: str, partitions: int | None = None) -> Index:
    """Rewrites an index that has many small files; its content, collection frequencies included, stays."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("an index can't be rewritten in its own place")
    save_index(load_index(spark, source), target, partitions)
    return load_index(spark, target)


def with_cutoff(index: Index, df_cutoff: int) -> Index:
    return replace(index, df_cutoff=df_cutoff)
