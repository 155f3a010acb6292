from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fathom.llm import fingerprint as fp
from fathom.llm.minhash import shingles

from .conftest import prose, table


def plain_boundaries(data: bytes) -> list[int]:
    out, at, h = [], 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[c])) & 0xFFFFFFFF
        size = i + 1 - at
        mask = int(fp.STRICT if size < fp.NORMAL else fp.LOOSE)
        if i + 1 == len(data) or size >= fp.LEAST and (h & mask == 0 or size >= fp.MOST):
            out.append(i + 1)
            at = i + 1
    return out


def test_boundaries_against_a_loop():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 48, 200, 5000):
        for data in (rng.randbytes(n), bytes(n), prose(rng, n // 8 + 1).encode()):
            assert fp.boundaries(np.frombuffer(data, dtype=np.uint8)) == plain_boundaries(data)


def test_shifts_and_containment():
    text = prose(random.Random(2), 800)
    a, b = fp.fingerprint(text), fp.fingerprint("Something in front. " + text)
    assert fp.containment(a, b) > 0.95 and fp.containment(a, a) == 1.0
    assert fp.containment(a, fp.fingerprint(prose(random.Random(3), 800))) < 0.02
    assert 0.65 < fp.containment(a, fp.fingerprint(fp.edited(text, prose(random.Random(4), 800)))) < 0.85
    assert (fp.decode(fp.encode(a)) == a).all()


def test_blocks_of_long_texts(monkeypatch):
    data = prose(random.Random(9), 900).encode() + bytes(500) + b"x" * 700
    raw = np.frombuffer(data, dtype=np.uint8)
    whole = fp.boundaries(raw), fp.chunks(data)[0].tolist(), shingles(data.decode(), 4).tolist()
    for size in (33, 100, 1024):
        monkeypatch.setattr(fp, "BLOCK", size)
        assert (fp.boundaries(raw), fp.chunks(data)[0].tolist(), shingles(data.decode(), 4).tolist()) == whole


def place(text):
    return ((xxhash.xxh64(text.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63) % fp.PLACES


def expected_rows(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, place(r[1]), r[1]))
    expected = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        other = fp.edited(text, after)
        mark = fp.fingerprint(text)
        expected.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), fp.encode(mark), fp.encode(fp.fingerprint(other)), fp.containment(mark, fp.fingerprint(other)), fp.containment(mark, fp.fingerprint(after))))
    return sorted(map(repr, expected))


def test_table_against_a_loop(spark, documents):
    found = fp.compare_with_next(table(spark, documents).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, found))) == expected_rows(documents)


def test_an_id_and_no_id_with_a_third_of_all_rows_are_many_tasks(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", "a") for i in [7] * 200 + [None] * 200 + [*range(100), *range(-50, 50)]]
    docs = table(spark, rows).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = fp.compare_with_next(docs)
        assert sorted(map(repr, map(tuple, found.collect()))) == expected_rows(rows)
        tasks = Counter((r.doc_id if r.doc_id == 7 else None, r.task) for r in found.withColumn("task", F.spark_partition_id()).where("doc_id = 7 OR doc_id IS NULL").collect())
        for i in (7, None):
            sizes = [n for (x, _), n in tasks.items() if x == i]
            assert len(sizes) >= 3 and max(sizes) < 110
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ids_of_one_value(spark):
    rows = [(5, t, "en", "a") for t in ("", None, "abc" * 40, "abc" * 40, "x")]
    found = fp.compare_with_next(table(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, found))) == expected_rows(rows)


def test_small_tables(spark):
    assert fp.compare_with_next(table(spark, [])).count() == 0
    one = fp.compare_with_next(table(spark, [(7, "abcdefgh", "en", "a")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
