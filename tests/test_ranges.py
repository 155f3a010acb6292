"""Numbers by ranges against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathom.functions import ranges
from fathom.plans import index as ix


@pytest.mark.parametrize("ids", [[], [5], list(range(500)), [7] * 40, [k * 10**15 - 4 * 10**18 for k in range(800)], [*range(20), *[3] * 200]])
def test_numbers(spark, ids):
    rows = [(i, k) for k, i in enumerate(ids)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, more int")
    found = {(r.id, r.more): r.at for r in ranges.number(df, "id", "more").collect()}
    assert found == {row: at for at, row in enumerate(sorted(rows), 1)}


def test_sparse_ids_fill_all_ranges(spark):
    df = spark.createDataFrame([(random.Random(k).getrandbits(60),) for k in range(2000)], "id long")
    sizes = [r["count"] for r in df.groupBy(ranges.range_of(df, "id", 16).alias("range")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 250


def test_an_index_is_not_compacted_in_its_place(spark, tmp_path):
    vectors = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "docid long, terms array<string>")
    for kind in ix.TYPES:
        made = ix.create_index(vectors, f"{tmp_path}/{kind}", kind, df_cutoff=0, with_vectors=kind == "tf")
        assert sorted((r.term, r.df, r.cf) for r in made.term_stats.collect()) == [("a", 1, 2), ("b", 2, 2)]
        assert (made.doc_vectors is not None) == (kind == "tf") and made.postings.count() == 3
    with pytest.raises(ValueError):
        ix.compact(spark, f"{tmp_path}/tf", f"{tmp_path}/tf/")


def test_ties_in_the_order_of_the_index(spark):
    from fathom.operators import rerank

    vectors = spark.createDataFrame([(1, 5, 1.0), (1, 9, 1.0)], "qid int, docid long, f1 double")
    assert [r.docid for r in rerank.rerank(vectors, [rerank.Node(0.5)], F.col("docid").desc()).orderBy("rank").collect()] == [9, 5]
    assert [r.docid for r in rerank.rerank(vectors, [rerank.Node(0.5)]).orderBy("rank").collect()] == [5, 9]
