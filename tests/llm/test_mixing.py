from __future__ import annotations

import math
import random
import re

import pytest

from fathom.llm import mixing

from .conftest import prose, table


def brute(rows, weights=(5, 2, 1)):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(have.values())
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += rest * w[s] / total
        rest = sum(target[s] - 2 * have[s] for s in open_ if target[s] > 2 * have[s])
        full = {s for s in open_ if target[s] >= 2 * have[s]}
        target |= {s: 2.0 * have[s] for s in full}
        open_ -= full
    return size, have, target


@pytest.mark.parametrize("ranges", [1, 64])
def test_against_resharing(spark, documents, ranges):
    size, have, target = brute(documents)
    found = mixing.mix(table(spark, documents), ranges=ranges).collect()
    assert len(found) == len(documents)
    for r in found:
        assert r.source_size == have[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
    for s in have:
        assert abs(sum(r.taken for r in found if r.source == s) - target[s]) <= 0.5001
    again = mixing.mix(table(spark, documents), ranges=7).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_epochs_come_first_and_weights_count(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 10), "en", "a" if k < 20 else "b") for k in range(400)]
    quality = spark.createDataFrame([(k, 8.0 if k % 2 else 1.0) for k in range(400)], "doc_id long, weight double")
    found = mixing.mix(table(spark, rows), quality=quality).collect()
    assert all(r.taken == 20 for r in found if r.source == "a")
    kept = [r for r in found if r.source == "b"]
    assert min(r.taken for r in kept) >= 10 or sum(r.taken for r in kept) < 3800
    twice = [r.doc_id % 2 for r in kept if r.taken == 20]
    assert sum(twice) > 0.7 * len(twice)


def test_empty_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(table(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()] == [(0.0, 0)] * 2
