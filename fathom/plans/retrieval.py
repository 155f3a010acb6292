"""From queries to output: candidates, features, re-ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import bloom, candidates, features, rerank
from fathom.operators.rerank import Node
from fathom.plans.index import Index

ALGORITHMS = ("SvS", "WAND", "MBWAND", "BWAND_OR", "BWAND_AND")
RANKED = ("WAND", "BWAND_OR")


def generate(index: Index, queries: DataFrame, algorithm: str, hits: int | None, hashes: int | None = None, bits: int = 8) -> DataFrame:
    """qid, docid and, for ranked algorithms, score and rank. With hashes, BWAND_AND asks Bloom filters and may find too much."""
    if algorithm == "SvS":
        return candidates.conjunction(index, queries, hits)
    if algorithm == "BWAND_AND":
        if hashes is None:
            return candidates.semi_conjunction(index, queries, hits)
        found = bloom.bloom_conjunction(index, queries, hashes, bits)
        return found if hits is None else found.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(index.newest_first()))).where(F.col("at") <= hits).drop("at")
    top = {"WAND": candidates.bm25_top, "MBWAND": candidates.idf_top, "BWAND_OR": candidates.rarest_top}
    if algorithm not in top:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    return top[algorithm](index, queries, hits or candidates.HITS)


def retrieve(
    index: Index, queries: DataFrame, algorithm: str = "SvS", hits: int | None = None, spec: Sequence[features.Feature] = (),
    static: DataFrame | None = None, model: Sequence[Node] = (), hashes: int | None = None,
) -> tuple[str, DataFrame]:
    """What kind of output it is (set, vectors or run), and its rows. Without document vectors features are left out."""
    found = generate(index, queries, algorithm, hits, hashes)
    if spec and index.doc_vectors is not None:
        vectors = features.extract(index, queries, found, list(spec), static)
        return ("run", rerank.rerank(vectors, model, index.newest_first())) if model else ("vectors", vectors)
    if algorithm in RANKED:
        return "run", found
    if model:
        order = Window.partitionBy("qid").orderBy(index.newest_first())
        return "run", found.withColumn("score", F.lit(0.0)).withColumn("rank", F.row_number().over(order))
    return "set", found
