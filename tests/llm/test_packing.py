from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from fathom.llm import packing, tokens

from .conftest import table


def check_windows(found, total):
    padded = 0
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        n = s.length.sum()
        assert n <= s.window.iloc[0] <= 4096 and s.window.nunique() == 1 == s.cost.nunique() and s.cost.iloc[0] == (s.length**2).sum()
        padded += 0 if n & (n - 1) == 0 else 4096 - n
    assert padded <= 0.01 * total


def test_every_id_lies_in_one_piece(spark, documents):
    docs = [r for r in documents if r[0] is not None][:-1]
    real = Tokenizer.from_file(tokens.default_path())
    expected = {i: [*real.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _, _ in docs}
    for keep in (0, 1 << 16):
        found = packing.pack(table(spark, docs).repartition(3, "doc_id"), pool_tokens=5000, keep_tokens=keep).toPandas()
        for doc_id, pieces in found.sort_values("start").groupby("doc_id"):
            assert (pieces.doc_tokens == len(expected[doc_id])).all()
            assert np.frombuffer(b"".join(pieces.ids), dtype="<u4").tolist() == expected[doc_id]
        assert set(found.doc_id) == set(expected)
        check_windows(found, found.length.sum())


def test_rests_of_many_partitions_meet(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs = [r for r in documents if r[0] is not None][:-1]
    found = packing.pack(table(spark, docs).repartition(12)).toPandas()
    assert found.length.sum() == found.drop_duplicates("doc_id").doc_tokens.sum()
    check_windows(found, found.length.sum())
    windows = found.drop_duplicates("sequence_id").window
    assert (windows < 512).sum() <= 9 and windows[windows < 512].is_unique
    short = found[found.doc_tokens <= 4096]
    assert short.groupby("doc_id").size().max() <= 10


def test_steps_are_alike_over_all_partitions(spark):
    rng = random.Random(2)
    docs = table(spark, [(k, "word " * rng.choice([rng.randint(1, 400), rng.randint(1, 3000), 9000]), "en", "a") for k in range(900)]).repartition(7)
    pieces = packing.pack(docs)
    steps = packing.balance_steps(pieces, step_tokens=32768)
    found = pieces.join(steps, "sequence_id").where("offset = 0").toPandas()
    assert len(found) == pieces.where("offset = 0").count() == steps.count()
    for tier in (512, 1024, 2048, 4096):
        mine = found[(found.window == tier) | ((found.window < 512) & (tier == 512))]
        sums = mine.groupby("step_id").agg(n=("window", "sum"), cost=("cost", "sum"))
        assert len(sums) == -(-len(mine) * tier // 32768) and sums.n.max() <= 32768
        if len(sums) > 2 and tier > 1024:
            assert sums.cost.max() <= 1.1 * sums.cost.min(), tier
    assert sorted(found.step_id.unique()) == list(range(found.step_id.nunique()))
    assert (found[found.window >= 512].groupby("step_id").window.nunique() == 1).all()


def test_any_tokenizer_gives_its_ids(spark, documents):
    path = tokens.public_path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    docs = [r for r in documents if r[0] is not None][:20]
    found = packing.pack(table(spark, docs), eos=50256, tokenizer=path).toPandas()
    for i, text, _, _ in docs:
        ids = b"".join(found[found.doc_id == i].sort_values("start").ids)
        assert np.frombuffer(ids, dtype="<u4").tolist() == [*real.encode(text or "", add_special_tokens=False).ids, 50256]


def test_empty_table_and_reruns(spark, documents):
    empty = packing.pack(table(spark, []))
    assert empty.count() == packing.balance_steps(empty).count() == 0
    docs = table(spark, documents).coalesce(1)
    order = ["sequence_id", "offset"]
    first, second = (packing.pack(docs).toPandas().sort_values(order, ignore_index=True) for _ in range(2))
    assert first.equals(second)


def test_chunks_have_the_texts_ids():
    import pyarrow as pa

    texts = ["Don't Stop!! it's (fine), 'tis X.Y", "İstanbul ŴÉ ẘord W̊ord ﬁn ß ẞ µ", "a<|endoftext|>b <|startoftext|> .", "１２ 3a a3 … ,, ''s 's", "x\u2003y\x1cz\u00a0w", None, "ÀÉÎ.,; Ωμ"]
    real = Tokenizer.from_file(tokens.default_path())
    ids, starts = tokens.ChunkEncoder(tokens.default_path(), 10).encode(pa.array(texts), 2)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*real.encode(text or "", add_special_tokens=False).ids, 2], text
