"""Ranking by tree ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Larger ensembles are walked over batches and not compiled.
MOST_NODES = 400


@dataclass(frozen=True)
class Node:
    """A leaf has a value; an inner node goes left where the feature (from 0) is at most the threshold."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def compile_tree(node: Node, columns: Sequence[str]) -> Column:
    if node.left is None:
        return F.lit(float(node.value))
    test = F.col(columns[node.feature]) <= F.lit(float(node.threshold))
    return F.when(test, compile_tree(node.left, columns)).otherwise(compile_tree(node.right, columns))


def flatten(node: Node) -> tuple[np.ndarray, ...]:
    """feature, threshold, left, right, value by node number; leaves lead to themselves."""
    rows: list[list[float]] = []

    def put(n: Node) -> int:
        at = len(rows)
        rows.append([0, np.inf, at, at, n.value])
        if n.left is not None:
            rows[at][0], rows[at][1] = n.feature, n.threshold
            rows[at][2] = put(n.left)
            rows[at][3] = put(n.right)
        return at

    put(node)
    a = np.array(rows, dtype=np.float64)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def depth(node: Node) -> int:
    return 0 if node.left is None else 1 + max(depth(node.left), depth(node.right))


def evaluate(trees: Sequence[Node], x: np.ndarray) -> np.ndarray:
    """Sums of the leaves that the rows of x reach; all rows go down a level at a time."""
    return walk([(flatten(t), depth(t)) for t in trees], x)


def walk(flat: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    """flat: flattened trees and their depths."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for (feature, threshold, left, right, value), levels in flat:
        at = np.zeros(len(x), dtype=int)
        for _ in range(levels):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += value[at]
    return total


def score(vectors: DataFrame, trees: Sequence[Node], most_nodes: int = MOST_NODES) -> DataFrame:
    """Adds score. Small ensembles become one expression; larger ones run over Arrow batches."""
    columns = sorted((c for c in vectors.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if sum(len(flatten(t)[0]) for t in trees) <= most_nodes:
        total = F.lit(0.0)
        for tree in trees:
            total = total + compile_tree(tree, columns)
        return vectors.withColumn("score", total)

    flat = [(flatten(t), depth(t)) for t in trees]

    @F.pandas_udf("double")
    def run(*features: pd.Series) -> pd.Series:
        return pd.Series(walk(flat, np.column_stack([f.to_numpy(dtype=np.float64) for f in features])))

    return vectors.withColumn("score", run(*[F.col(c).cast("double") for c in columns]))


def rerank(vectors: DataFrame, trees: Sequence[Node], ties: Column | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """qid, docid, score, rank; equal scores in the order of ties, by docid if none is given."""
    scored = score(vectors, trees, most_nodes).withColumn("score", F.round("score", 4))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("docid").asc() if ties is None else ties)
    return scored.withColumn("rank", F.row_number().over(order)).select("qid", "docid", "score", "rank")
