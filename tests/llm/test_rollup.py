from __future__ import annotations

import base64
import collections
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from fathom.llm import rollup as ru
from fathom.llm import tokens
from fathom.llm.rollup import TokenRollup
from fathom.llm.storage import fresh_path

from .conftest import prose, table

SCHEMA = "source string, lang string, version string, tokens long, sign int, n_docs string"


def rows(spark, *found):
    return spark.createDataFrame([(*r, "x") for r in found], SCHEMA)


def totals(rollup):
    return sorted(map(repr, map(tuple, rollup.totals().collect())))


def test_deltas(spark):
    r = TokenRollup(spark, fresh_path(spark, "rollup"))
    assert totals(r) == []
    first = rows(spark, ("a", "en", "v1", 5, 1), ("a", "en", "v1", 5, 1), (None, None, "v1", 0, 1), ("b", "de", "v1", 7, 1))
    assert r.commit("1", first) and not r.commit("1", first)
    assert totals(r) == sorted(map(repr, [("a", "en", "v1", 2, 10), (None, None, "v1", 1, 0), ("b", "de", "v1", 1, 7)]))
    assert r.commit("2", rows(spark, ("b", "de", "v1", 7, -1), ("a", "en", "v1", 5, -1), ("a", "en", "v2", 8, 1)))
    expected = sorted(map(repr, [("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 8), (None, None, "v1", 1, 0)]))
    assert totals(r) == expected
    r.compact()
    assert totals(r) == expected and not r.commit("2", first)
    assert r.commit("3", rows(spark)) and r.commit("4", rows(spark, ("c", "fr", "v2", 1, 1)))
    again = sorted([*expected, repr(("c", "fr", "v2", 1, 1))])
    assert totals(r) == again
    r.compact()
    assert totals(TokenRollup(spark, r.path)) == again


def test_a_commit_while_compaction_runs(spark, monkeypatch):
    r = TokenRollup(spark, fresh_path(spark, "rollup"))
    other = TokenRollup(spark, r.path)
    assert r.commit("1", rows(spark, ("a", "en", "v1", 5, 1)))
    real = TokenRollup._sums

    def meanwhile(self, base, batches):
        monkeypatch.setattr(TokenRollup, "_sums", real)
        assert other.commit("2", rows(spark, ("a", "en", "v1", 7, 1)))
        other.compact()  # holds both; the first one's base, which is written later, holds one
        return real(self, base, batches)

    monkeypatch.setattr(TokenRollup, "_sums", meanwhile)
    r.compact()
    expected = [repr(("a", "en", "v1", 2, 12))]
    assert totals(r) == totals(other) == expected
    for k in range(3):
        assert not r.commit("1", rows(spark, ("a", "en", "v1", 5, 1))) and not r.commit("2", rows(spark, ("a", "en", "v1", 7, 1)))
        assert r.commit(f"x{k}", rows(spark, ("b", "en", "v1", 1, 1)))
        r.compact()
        assert totals(r) == sorted([*expected, repr(("b", "en", "v1", k + 1, k + 1))])
    assert r._whole("batches") == ["x2"]  # what the newest base holds; those before it are removed


def plain_ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_against_whole_texts(monkeypatch):
    plain = plain_ranks()
    rng = random.Random(4)
    texts = [prose(rng, 80), "", "x  y   z\n\n a\u00a0b " * 30, "don't 12 a1 _ é " * 50, " " * 70 + "a" + "\n" * 60 + " b" + " " * 55, "<|endoftext|> a"]
    monkeypatch.setattr(tokens.RankCounter, "PART", 50)
    monkeypatch.setattr(tokens.RankCounter, "RUN", 40)
    counter = tokens.RankCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [counter(t) for t in texts] == [len(plain.encode_ordinary(t)) for t in texts]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        real = Tokenizer.from_file(public_tokenizers.path(name))
        found = tokens.counts(public_tokenizers.path(name), pa.array([*texts, None]))
        assert found.tolist() == [len(real.encode(t, add_special_tokens=False).ids) for t in texts] + [0]


def test_very_long_texts():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = tokens.counts(path, pa.array([" " * 2_000_000, "a" * 100_000, "word " * 300_000])).tolist()
    assert found[2] == 300_001 and all(n > 0 for n in found)


def test_query_against_loops(spark, documents, tmp_path):
    named = [r for r in documents if r[0] is not None]
    table(spark, documents).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, k % 2, int(k % 5 == 0)) for k, i in enumerate(sorted({r[0] for r in named})) if k % 3]
    spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    by = {i: (q, t) for i, q, t in labels}
    words, plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), plain_ranks()
    sums: dict = collections.defaultdict(lambda: [0, 0])
    for i, text, lang, source in documents:
        quality, toxic = by.get(i, (0, 0))
        if not toxic:
            name = "byte_bpe_50k" if quality else "word_bpe_49k"
            n = len(plain.encode_ordinary(text or "")) if quality else len(words.encode(text or "", add_special_tokens=False).ids)
            entry = sums[source, lang, name]
            entry[0] += 1
            entry[1] += n
    found = ru.op5_token_rollup(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((*k, *v)) for k, v in sums.items())


def test_query_on_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert ru.op5_token_rollup(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "A b", "x", "y")], "doc_id long, text string, n0 string, sums string")
    row = ru.count_tokens(docs, [public_tokenizers.path(name)]).first()
    assert (row.doc_id, row.n0, row.sums) == (1, 2, "y")
