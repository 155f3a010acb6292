"""Block-wise Bloom filters over postings, and what they find, in column expressions.

Postings of a term are cut into blocks of 128 documents. A block's filter has
``bits`` bits for each document, in words of 32; a document sets one bit for each
of ``hashes`` functions of the family ``(a * docid + b) mod p``, p = 2**31 - 1. A
document is looked for in the first block whose last document isn't before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.access import postings_for, rarest, resolve
from fathom.plans.index import Index

BLOCK = 128
PRIME, ROOT = (1 << 31) - 1, 48271
RANGE = 65536  # documents


def factors(hashes: int) -> list[tuple[int, int]]:
    """a and b of each function: powers of a primitive root, so no two are alike."""
    return [(pow(ROOT, 2 * k + 1, PRIME), pow(ROOT, 2 * k + 2, PRIME)) for k in range(hashes)]


def bits_of(docid: Column, words: Column, hashes: int) -> list[Column]:
    """The bits that a document sets in a filter of so many words."""
    folded = F.pmod(docid, F.lit(PRIME))
    return [F.pmod(F.pmod(folded * F.lit(a) + F.lit(b), F.lit(PRIME)), words * 32) for a, b in factors(hashes)]


def words_for(n: Column, bits: int) -> Column:
    return F.ceil(n * bits / 32).cast("long")


def _numbered(index: Index, terms: DataFrame | None) -> DataFrame:
    """term, docid, at, block. Postings are numbered in two steps, by ranges of documents and within them, so that a frequent term isn't one task's."""
    p = index.postings.select("term", "docid") if terms is None else postings_for(index, terms, "docid").join(terms, "term", "left_semi")
    p = p.join(index.searchable().select("term"), "term", "left_semi")
    p = p.withColumn("at", (-1 if index.reverse else 1) * F.col("docid")).withColumn("range", F.floor(F.col("at") / RANGE))
    sizes = p.groupBy("term", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("term", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("term", "range").orderBy("at")
    return p.join(starts, ["term", "range"]).select("term", "docid", "at", F.floor((F.col("start") + F.row_number().over(within) - 1) / BLOCK).alias("block"))


def blocks(index: Index, hashes: int = 3, bits: int = 8, terms: DataFrame | None = None) -> DataFrame:
    """term, block, last (of the block, in the order of the index), n, filter (its words); of the terms in terms (term), or of all."""
    p = _numbered(index, terms).groupBy("term", "block").agg(F.max("at").alias("last_at"), F.collect_list("docid").alias("ids"))
    last = ((-1 if index.reverse else 1) * F.col("last_at")).alias("last")
    return p.select("term", "block", last, "ids").mapInArrow(_filters(hashes, bits), "term string, block long, last long, n long, filter array<long>")


def _filters(hashes: int, bits: int):
    """Rows of a block with the ids of its documents into those with its filter; as bits_of and words_for have it."""
    functions, prime = factors(hashes), PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            n = pc.list_value_length(ids).to_numpy().astype(np.int64)
            docid = np.mod(ids.flatten().to_numpy(), prime)
            words = -(-n * bits // 32)
            ends = np.cumsum(words)
            first, size = np.repeat(ends - words, n), np.repeat(32 * words, n)
            found = np.zeros(words.sum(), dtype=np.int64)
            for a, b in functions:
                bit = (docid * a + b) % prime % size
                np.bitwise_or.at(found, first + bit // 32, np.left_shift(np.int64(1), bit % 32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_pydict({"term": batch.column("term"), "block": batch.column("block"), "last": batch.column("last"), "n": pa.array(n), "filter": lists})

    return run


def contains(words: Column, docid: Column, hashes: int) -> Column:
    """Whether a filter says that it has the document."""
    bits = bits_of(docid, F.size(words).cast("long"), hashes)
    tests = [F.getbit(F.element_at(words, (F.floor(b / 32) + 1).cast("int")), (b % 32).cast("int")) == 1 for b in bits]
    return reduce(lambda x, y: x & y, tests)


def _placed(asked: DataFrame, lasts: DataFrame) -> DataFrame:
    """asked: term, at; lasts: term, at, block. Adds to asked the first block that ends there or later, null if none does.

    Ends and questions meet in ranges of documents; a range's questions after its
    last end get the first end of a later range, found by a row for each range. Both
    are walked from the end: a frame of following rows is made anew for each row.
    """
    with_range = lambda df: df.withColumn("range", F.floor(F.col("at") / RANGE))
    asked, lasts = with_range(asked), with_range(lasts)
    ranges = lasts.groupBy("term", "range").agg(F.min(F.struct("at", "block")).alias("first"))
    ranges = ranges.unionByName(asked.select("term", "range").distinct(), allowMissingColumns=True).groupBy("term", "range").agg(F.max("first").alias("first"))
    later = Window.partitionBy("term").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = ranges.select("term", "range", F.last("first", ignorenulls=True).over(later).alias("next")).where(F.col("next").isNotNull())
    ends = lasts.select("term", "range", "at", "block").unionByName(after.select("term", "range", "next.at", "next.block"))
    both = ends.unionByName(asked.select("term", "range", "at", F.lit(None).cast("long").alias("block")))
    # Of one document, the block's end comes after the question, so that it is found.
    ahead = Window.partitionBy("term", "range").orderBy(F.col("at").desc(), F.col("block").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("into", F.last("block", ignorenulls=True).over(ahead)).where(F.col("block").isNull()).select("term", "at", "into")


def membership(index: Index, filters: DataFrame, pairs: DataFrame, hashes: int = 3) -> DataFrame:
    """pairs: term, docid and any others. Adds ``inside``: whether the filters say that the term has the document."""
    order = -1 if index.reverse else 1
    asked = pairs.select("term", "docid").distinct().select("term", (order * F.col("docid")).alias("at"))
    lasts = filters.select("term", (order * F.col("last")).alias("at"), "block")
    found = _placed(asked, lasts).join(filters.withColumnRenamed("block", "into"), ["term", "into"], "left")
    found = found.select("term", (order * F.col("at")).alias("docid"), "last", "filter")
    inside = F.when(F.col("filter").isNull(), F.lit(False)).when(F.col("last") == F.col("docid"), F.lit(True)).otherwise(contains(F.col("filter"), F.col("docid"), hashes))
    return pairs.join(found.select("term", "docid", inside.alias("inside")), ["term", "docid"])


def bloom_conjunction(index: Index, queries: DataFrame, hashes: int = 3, bits: int = 8) -> DataFrame:
    """qid, docid: the rarest term's documents of which the filters say that all other terms have them: no document less than there are."""
    asked = resolve(index, queries)
    low = rarest(asked).select("qid", "term")
    others = asked.select("qid", "term").distinct().join(low, ["qid", "term"], "left_anti")
    found = low.join(postings_for(index, low, "docid"), "term").select("qid", "docid")
    pairs = found.join(others, "qid")
    told = membership(index, blocks(index, hashes, bits, others.select("term").distinct()), pairs, hashes)
    missed = told.where(~F.col("inside")).select("qid", "docid").distinct()
    return found.join(missed, ["qid", "docid"], "left_anti")
