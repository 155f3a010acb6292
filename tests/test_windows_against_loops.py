"""Window counts against plain loops over their rules."""

from __future__ import annotations

import random

from fathom.operators.features import ordered_count, unordered_count
from pyspark.sql import functions as F


def ordered(left, right, gap):
    return sum(any(1 <= n - p <= gap + 1 for n in right) for p in left)


def unordered(left, right, window):
    total, before = 0, 0
    for p in left:
        total += sum(1 for n in right if before < n < p and p - n + 1 <= 2 * window)
        total += any(n > p and n - p + 1 <= 2 * window for n in right)
        before = p
    return total


def test_counts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        left, right = (sorted(rng.sample(range(1, 40), rng.randint(0, 9))) for _ in range(2))
        if k % 10 == 0:
            right = left
        rows.append((k, left, right))
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    for size in (0, 1, 4):
        found = {r.k: (r.o, r.u) for r in df.select("k", ordered_count(F.col("a"), F.col("b"), size).alias("o"), unordered_count(F.col("a"), F.col("b"), size).alias("u")).collect()}
        assert found == {k: (ordered(a, b, size), unordered(a, b, size)) for k, a, b in rows}
