"""Features of (query, document) pairs.

The pairs' terms are gathered in one row each; every feature is then an
expression over that row, so any number of features costs one join. Pairs of
neighbouring query terms are compared by their positions in the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.operators.access import held, postings_for, resolve
from fathom.plans.index import Index


#: Pairs whose windows are one task's.
EACH = 256


@dataclass(frozen=True)
class Feature:
    """scorer: BM25 (k1, b) or Dirichlet (mu). kind: Term, OD (ordered, gap) or UW (unordered, window)."""

    scorer: str
    kind: str
    k1: float = 0.0
    b: float = 0.0
    mu: float = 0.0
    gap: int = 0
    window: int = 0

    def __post_init__(self):
        if self.scorer not in scoring.SCORERS or self.kind not in ("Term", "OD", "UW"):
            raise ValueError(f"unknown feature: {self.scorer} {self.kind}")


def window_counts(left: Column, right: Column, kinds: Sequence[tuple[str, int]]) -> Column:
    """A struct of one count for each kind (OD and a gap, UW and a window), all from one pass over both terms' positions.

    OD: positions of the left term that the right one follows by at most gap + 1.
    UW: for each position of the left term, all of the right one's since its last
    and within the span before it, and one after it; a span has twice ``window`` tokens.

    Positions are merged and walked from the end, so each one's distance to the
    next of the other term is at hand: a left position counts forward by that, a
    right one backward, unless it is a left position itself.
    """
    merged = F.reverse(F.array_sort(F.concat(F.transform(left, lambda p: 2 * p + 1), F.transform(right, lambda n: 2 * n))))
    zero = F.lit(0)
    start = F.struct(zero.alias("left"), zero.alias("right"), *(zero.alias(f"n{k}") for k in range(len(kinds))))

    def onward(acc: Column, x: Column) -> Column:
        is_left, at = x % 2 == 1, F.floor(x / 2).cast("int")
        ahead = F.when(is_left, acc["right"]).otherwise(acc["left"]) - at
        counts = []
        for k, (kind, size) in enumerate(kinds):
            most = size + 1 if kind == "OD" else 2 * size - 1
            hit = ahead.between(1, most) & is_left if kind == "OD" else ahead.between(1, most)
            counts.append((acc[f"n{k}"] + hit.cast("int")).alias(f"n{k}"))
        return F.struct(F.when(is_left, at).otherwise(acc["left"]).alias("left"), F.when(is_left, acc["right"]).otherwise(at).alias("right"), *counts)

    return F.aggregate(merged, start, onward)


def ordered_count(left: Column, right: Column, gap: int) -> Column:
    return window_counts(left, right, [("OD", gap)])["n0"]


def unordered_count(left: Column, right: Column, window: int) -> Column:
    return window_counts(left, right, [("UW", window)])["n0"]


def _score(f: Feature, count: Column, doc_len: Column, idf: Column, cf: Column) -> Column:
    if f.scorer == "BM25":
        return scoring.bm25(count, doc_len, F.col("avgdl"), idf, f.k1, f.b)
    return scoring.dirichlet(count, doc_len, cf, F.col("total_len"), f.mu)


def _windows(features: Sequence[Feature]) -> list[tuple[str, int]]:
    """The different windows that the features count."""
    return sorted({(f.kind, f.gap if f.kind == "OD" else f.window) for f in features if f.kind != "Term"})


def neighbours(features: Sequence[Feature]) -> Column:
    """Over a row with asked: the counts of each two neighbouring terms."""
    kinds = _windows(features)
    pairs = F.when(F.size("asked") > 1, F.sequence(F.lit(1), F.size("asked") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.element_at("asked", i)["positions"]
    return F.transform(pairs, lambda i: window_counts(at(i), at(i + 1), kinds))


def expression(f: Feature, features: Sequence[Feature]) -> Column:
    """Over a row with asked (the query's terms in order), pairs (of neighbours), doc_len and the collection's statistics."""
    if f.kind == "Term":
        each = F.transform("asked", lambda t: _score(f, t["tf"], F.col("doc_len"), t["idf"], t["cf"]))
    else:
        n = "n" + str(_windows(features).index((f.kind, f.gap if f.kind == "OD" else f.window)))
        each = F.transform("pairs", lambda c: _score(f, c[n], F.col("doc_len"), F.col("default_idf"), F.col("default_cf")))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


def gather(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: qid, docid. One row each with doc_len, asked and the collection's statistics."""
    index.need("positions")
    asked, pairs = held(resolve(index, queries)), held(pairs.select("qid", "docid"))
    docids = held(pairs.select("docid").distinct())
    # Only the pairs' documents: what is left of the postings is about as large as the pairs.
    found = postings_for(index, asked, "docid", "tf", "positions").join(docids, "docid", "left_semi")
    rows = pairs.select("qid", "docid").join(asked, "qid").join(found, ["term", "docid"], "left")
    item = F.struct("ord", "idf", "cf", F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("positions", F.array().cast("array<int>")).alias("positions"))
    # Windows take long over few bytes, so the number of tasks isn't left to the bytes.
    rows = rows.repartition(docids.count() // EACH + 1, "qid", "docid").groupBy("qid", "docid").agg(F.array_sort(F.collect_list(item)).alias("asked"))
    return rows.join(index.doc_stats.join(docids, "docid", "left_semi"), "docid").crossJoin(F.broadcast(index.stats))


def extract(index: Index, queries: DataFrame, pairs: DataFrame, features: list[Feature], static: DataFrame | None = None) -> DataFrame:
    """qid, docid, f1, f2, … and the columns of static (docid, …), 0 where a document has none."""
    found = gather(index, queries, pairs)
    if _windows(features):
        found = found.withColumn("pairs", neighbours(features))
    found = found.select("qid", "docid", *[expression(f, features).alias(f"f{i}") for i, f in enumerate(features, 1)])
    if static is not None:
        names = [c for c in static.columns if c != "docid"]
        found = found.join(static, "docid", "left").fillna(0, names)
        found = found.select("qid", "docid", *[f"f{i}" for i in range(1, len(features) + 1)], *[F.col(c).cast("double").alias(f"f{len(features) + i}") for i, c in enumerate(names, 1)])
    return found
