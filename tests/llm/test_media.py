from __future__ import annotations

import hashlib
import os
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from fathom.llm import media
from fathom.llm.storage import fresh_path

from .conftest import table


def test_round_trip(spark, documents):
    rows, members = media.store_payloads(table(spark, documents).repartition(3), fresh_path(spark, "media"), shard_bytes=4000)
    found = rows.join(media.read_features(media.fill_metadata(members)), "key").collect()
    assert len(found) == len(documents) and len({r.shard for r in found}) > 3
    assert len({(r.shard, r.offset) for r in found}) == len({r.digest for r in found}) == members.count()
    texts = {(i, len((t or "").encode())): t or "" for i, t, _, _ in documents}
    for r in found:
        payload = media.payload_of(texts[r.doc_id, r.n_bytes])
        assert payload.rstrip(b"\0") == texts[r.doc_id, r.n_bytes].encode() and len(payload) % 64 == 0 and payload
        stored = media.to_png(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bits, r.length) == (64, len(payload) // 64, 8, len(stored))
        assert r.media_sha256 == r.digest == hashlib.sha256(stored).hexdigest() and r.feature == media.features_of(payload)
    with tarfile.open(found[0].shard.removeprefix("file:")) as tar:
        for member in tar.getmembers():
            assert member.name == hashlib.sha256(tar.extractfile(member).read()).hexdigest() + ".png"


def test_equal_payloads_are_stored_once_over_all_tasks(spark, tmp_path):
    docs = table(spark, [(k, "same text" if k % 2 else f"text {k % 10}", "en", "a") for k in range(80)] + [(None, None, None, None), (1, "", None, None), (2, "own", None, None)])
    rows, members = media.store_payloads(docs.repartition(4), str(tmp_path / "one"))
    assert rows.count() == 83 and members.count() == members.select("shard", "offset").distinct().count() == 8
    names = [m.name for path in (tmp_path / "one").glob("*.tar") for m in tarfile.open(path).getmembers()]
    assert len(names) == len(set(names)) == 8
    found = rows.join(members, "key").groupBy("key").agg(F.count_distinct("shard", "offset").alias("n")).collect()
    assert len(found) == 8 and all(r.n == 1 for r in found)


def test_no_rows_make_no_shard(spark, tmp_path):
    rows, members = media.store_payloads(table(spark, []), str(tmp_path / "none"))
    assert rows.count() == members.count() == 0 and media.read_features(media.fill_metadata(media.spread_index(members))).count() == 0
    assert not list((tmp_path / "none").glob("*")) if (tmp_path / "none").exists() else True


def test_spreading_keeps_the_members(spark, documents):
    members = media.store_payloads(table(spark, documents).repartition(3), fresh_path(spark, "media"), shard_bytes=4000)[1]
    spread = media.spread_index(members, piece_bytes=3000)
    assert spread.rdd.getNumPartitions() > 3
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, members.collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in media.op7_store_media(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        payload = media.payload_of(text or "")
        r = found[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.media_bytes == len(media.to_png(payload))
