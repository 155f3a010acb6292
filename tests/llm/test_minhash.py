from __future__ import annotations

import random
import re

import numpy as np
import pytest

from fathom.llm import minhash
from fathom.llm.graph import components

from .conftest import prose, table


def plain_set(text, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute(rows, width):
    sets = [(r[0], plain_set(r[1], width)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets]


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, documents, width):
    found = minhash.near_duplicates(table(spark, documents), width)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(documents, width)))


def test_a_large_group_in_small_blocks(spark, monkeypatch):
    """Copies at all distances from a base that isn't the first: some are linked to others only."""
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", 2000)
    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(100), rng.randint(0, 5)):
            w[at] = rng.choice(["one", "two", "three"])
        rows.append((k, " ".join(w), "en", "a"))
    found = minhash.near_duplicates(table(spark, rows), 4)
    expected = brute(rows, 4)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert 1 < len({r[2] for r in expected}) < 100


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b = prose(rng, 50), prose(rng, 50)
    found = minhash.near_duplicates(table(spark, [(1, a, "", ""), (5, a, "", ""), (5, b, "", ""), (9, b, "", "")]))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 5: 1, 9: 1}
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * share)
        a, b = x[:1000], np.concatenate((x[:n], x[1000 : 2000 - n]))
        same = (minhash.signature(np.sort(a), 1000) == minhash.signature(np.sort(b), 1000)).mean()
        assert abs(same - n / (2000 - n)) < 0.06


def test_shifts_are_circular():
    x = np.arange(10, dtype=np.uint64)
    sig = minhash.signature(x, 160)
    places = (minhash._mix(x ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(int)
    order = minhash._permutation(160)[:, 0][: minhash.UNIVERSE]
    assert sig.tolist() == [min(order[(p + k) % minhash.UNIVERSE] for p in places) for k in range(160)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(260)) if a < b] + [(k, k + 1) for k in range(500, 600)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
