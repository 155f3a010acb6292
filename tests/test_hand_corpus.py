"""Ten small documents with results worked out by hand."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.operators import access, bloom, candidates, features
from fathom.plans import index as ix
from fathom.plans.retrieval import retrieve

DOCS = {1: "a b c a b", 2: "b a x b", 3: "a a c", 4: "c b", 5: "x x", 6: "c x a", 7: "y", 8: "y z", 9: "z z y", 10: "y"}


def vectors(spark, docs=None):
    rows = [(k, v.split()) for k, v in (docs or DOCS).items()]
    return spark.createDataFrame(rows, "docid long, terms array<string>")


def asked(spark, *queries: str):
    rows = [(q, i, t) for q, text in enumerate(queries, 1) for i, t in enumerate(text.split(), 1)]
    return spark.createDataFrame(rows, "qid int, ord int, term string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "hand")
    ix.save_index(ix.build_index(vectors(spark), df_cutoff=0), path, 2)
    return ix.load_index(spark, path)


def ranked(df):
    return [(r.docid, r.score) for r in df.orderBy("qid", "rank").collect()]


def test_statistics(index):
    s = index.stats.first()
    assert (s.n_docs, s.total_len, s.default_df) == (10, 26, 0)
    t = {r.term: r for r in index.term_stats.collect()}
    assert {k: t[k].df for k in "abcx"} == {"a": 4, "b": 3, "c": 4, "x": 3}
    assert {k: t[k].cf for k in "abcx"} == {"a": 6, "b": 5, "c": 4, "x": 4}
    assert round(t["a"].idf, 4) == 0.3677 and round(t["x"].idf, 4) == 0.7621


def test_conjunction(index, spark):
    from dataclasses import replace

    q = asked(spark, "a b")
    both = {1, 2}
    assert {r.docid for r in candidates.conjunction(index, q).collect()} == both
    assert {r.docid for r in candidates.semi_conjunction(index, q).collect()} == both
    assert [r.docid for r in candidates.conjunction(replace(index, reverse=True), q, 1).collect()] == [2]
    assert {r.docid for r in candidates.intersection(index, "a", "b").collect()} == both


def test_unknown_terms_are_left_out_and_empty_queries_give_nothing(index, spark):
    q = asked(spark, "a b nosuch", "nosuch")
    assert {(r.qid, r.docid) for r in candidates.conjunction(index, q).collect()} == {(1, 1), (1, 2)}
    assert candidates.bm25_top(index, asked(spark, "nosuch")).count() == 0


def test_bm25(index, spark):
    assert ranked(candidates.bm25_top(index, asked(spark, "a b"))) == [(1, 1.2847), (2, 1.2349), (4, 0.7801), (3, 0.4372), (6, 0.3622)]
    assert ranked(candidates.bm25_top(index, asked(spark, "b c"))) == [(1, 1.2032), (4, 1.1566), (2, 0.8859), (3, 0.3622), (6, 0.3622)]
    assert ranked(candidates.bm25_top(index, asked(spark, "b x"))) == [(2, 1.6091), (5, 0.9274), (1, 0.8666), (4, 0.7801), (6, 0.7506)]


def test_repeated_query_terms_count_twice(index, spark):
    once, twice = (dict(ranked(candidates.bm25_top(index, asked(spark, q)))) for q in ("a", "a a"))
    assert all(abs(twice[d] - 2 * s) < 2e-4 for d, s in once.items())


def test_rarest(index, spark):
    assert ranked(candidates.rarest_top(index, asked(spark, "a b"))) == [(1, 1.1299), (2, 1.1299), (4, 0.7621)]


def test_windows(index, spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "qid int, docid long")
    rows = features.gather(index, asked(spark, "a b"), pairs)
    a, b = F.col("asked")[0]["positions"], F.col("asked")[1]["positions"]
    found = rows.select(
        "docid", features.ordered_count(a, b, 0), features.ordered_count(a, b, 1), features.unordered_count(a, b, 1), features.unordered_count(a, b, 2)
    )
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, 2, 3), (2, 0, 1, 1, 2)}


def test_dirichlet(spark, index):
    row = spark.range(1).select(
        scoring.dirichlet(F.lit(0), F.lit(2), F.lit(6), F.lit(26), 10), scoring.dirichlet(F.lit(2), F.lit(5), F.lit(6), F.lit(26), 10)
    ).first()
    assert [round(x, 4) for x in row] == [-1.6487, -1.2476]


def test_bloom_finds_at_least_what_is_there(index, spark):
    q = asked(spark, "a b", "c x a", "y z")
    exact = {tuple(r) for r in candidates.conjunction(index, q).collect()}
    for reverse in (False, True):
        assert exact <= {tuple(r) for r in bloom.bloom_conjunction(replace(index, reverse=reverse), q, 2, 4).collect()}


@pytest.mark.parametrize("reverse", [False, True])
def test_blocks_over_ranges_of_documents(spark, monkeypatch, reverse):
    """Questions are placed by loops over all ends; documents lie in many ranges."""
    monkeypatch.setattr(bloom, "RANGE", 100)
    ids = {"a": [*range(1, 400), 2000, 2001, 5000], "b": [7, 3000]}
    docs = sorted({d for v in ids.values() for d in v})
    one = ix.build_index(spark.createDataFrame([(d, [t for t in ids if d in ids[t]]) for d in docs], "docid long, terms array<string>"), df_cutoff=0, reverse=reverse)
    filters = bloom.blocks(one)
    for term, found in ids.items():
        order = sorted(found, reverse=reverse)
        lasts = [order[min(k + 127, len(order) - 1)] for k in range(0, len(order), 128)]
        assert [r["last"] for r in filters.where(F.col("term") == term).orderBy("block").collect()] == lasts
    asked = [(t, d) for t in ids for d in (1, 7, 128, 129, 399, 400, 650, 2000, 2500, 3000, 5000, 6000)]
    told = {(r.term, r.docid): r.inside for r in bloom.membership(one, filters, spark.createDataFrame(asked, "term string, docid long")).collect()}
    assert set(told) == set(asked) and all(told[t, d] for t, d in asked if d in ids[t])
    assert reverse or not told["a", 6000]  # nothing ends after it


def test_cutoff_types_and_errors(spark, tmp_path):
    one = ix.build_index(vectors(spark), "docids", df_cutoff=3)
    assert {r.term for r in access.vocabulary(one).collect()} == {"a", "c", "y"}
    assert access.postings_of(one, "b").count() == 0 == access.postings_of(one, "nosuch").count()
    with pytest.raises(ValueError, match="tf"):
        candidates.bm25_top(one, asked(spark, "a"))
    with pytest.raises(ValueError, match="index_type"):
        ix.build_index(vectors(spark), "other")


def test_dictionary_and_positions(index, spark):
    assert [r.term for r in ix.dictionary(vectors(spark)).orderBy("termid").collect()] == ["a", "b", "c", "x", "y", "z"]
    found = access.query_positions(index, asked(spark, "a b"), spark.createDataFrame([(1,)], "docid long"))
    assert {(r.term, tuple(r.positions)) for r in found.collect()} == {("a", (1, 4)), ("b", (2, 5))}


def test_compaction_keeps_everything(index, spark, tmp_path):
    ix.save_index(index, str(tmp_path / "a"), 3)
    again = ix.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), 1)
    assert sorted(map(tuple, again.term_stats.collect())) == sorted(map(tuple, index.term_stats.collect()))
    assert again.df_cutoff == 0 and again.postings.count() == index.postings.count()


def test_retrieve_kinds(index, spark):
    q = asked(spark, "a b")
    spec = [features.Feature("BM25", "Term", k1=0.5, b=0.3)]
    assert retrieve(index, q)[0] == "set" and retrieve(index, q, "WAND")[0] == "run"
    kind, rows = retrieve(index, q, "WAND", 3, spec)
    assert kind == "vectors" and {(r.docid, round(r.f1, 4)) for r in rows.collect()} == {(1, 1.2847), (2, 1.2349), (4, 0.7801)}
    with pytest.raises(ValueError, match="algorithm"):
        retrieve(index, q, "other")


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "c c"), (2, "b a a"), (2, None), (3, None), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ix.tokenized(docs, F.col("doc_id"), F.col("text"))
    assert sorted((str(r.docid), r.terms) for r in found.collect()) == [("1", ["a", "b"]), ("2", ["b", "a", "a"]), ("3", []), ("None", ["a"]), ("None", ["a"])]
    i = ix.build_index(found.where("docid IS NOT NULL"), df_cutoff=0)
    assert sorted(tuple(r) for r in i.postings.select("term", "docid", "tf", "doc_len", "positions").collect()) == [
        ("a", 1, 1, 2, [1]), ("a", 2, 2, 3, [2, 3]), ("b", 1, 1, 2, [2]), ("b", 2, 1, 3, [1]),
    ]
    assert (i.stats.first().n_docs, i.stats.first().total_len) == (3, 5)


def test_empty_collection(spark):
    none = ix.build_index(spark.createDataFrame([], "docid long, terms array<string>"))
    assert candidates.bm25_top(none, asked(spark, "a")).count() == 0
    assert none.stats.first().n_docs == 0
