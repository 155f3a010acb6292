"""Scores as column expressions, in double precision.

n_docs, total_len and avgdl come from the collection's one row of statistics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 0.5, 0.3


def idf(df: Column, n_docs: Column) -> Column:
    """Negative for terms in more than half of the documents."""
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_tf(tf: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.lit(1.0 + k1) * tf / (F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * doc_len / avgdl) + tf)


def bm25(tf: Column, doc_len: Column, avgdl: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    """0 where the term (or phrase) doesn't occur, even with k1 = 0."""
    return F.when(tf > 0, bm25_tf(tf, doc_len, avgdl, k1, b) * idf).otherwise(F.lit(0.0))


def dirichlet(tf: Column, doc_len: Column, cf: Column, total_len: Column, mu: float) -> Column:
    """Log probability with Dirichlet smoothing; not 0 where the term doesn't occur."""
    return F.log((tf + F.lit(float(mu)) * cf / total_len) / (doc_len + F.lit(float(mu))))


SCORERS: dict[str, Callable[..., Column]] = {"BM25": bm25, "Dirichlet": dirichlet}
