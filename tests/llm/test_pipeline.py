from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fathom.llm import registry

from .conftest import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    folder = str(tmp_path)
    docs = table(spark, documents).withColumnsRenamed({"hub": "mixed.case", "node": "Text_", "c1": "d_kept", "key": "extra3"})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, found = found, stage(spark, found, folder).persist()
        assert found.columns == docs.columns, name
        if name == "language":
            assert set(ids(before)) - set(ids(found)) == {"0", "1", "2"}
        if name == "near_duplicates":
            gone = set(ids(before)) - set(ids(found))
            assert {"5", "11", "12", "13", "14"} <= gone and {"4", "10", "3"} <= set(ids(found))
        if name == "mix":
            words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
            assert 1.2 * words(before) < words(found) < 1.8 * words(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, found, folder)
    assert set(ids(pieces)) == set(ids(found))
    # Where documents are cut depends on their partitions.
    assert ids(corpus_pipeline.run(spark, folder).where("start = 0")) == ids(pieces.where("start = 0"))


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_component(spark, documents):
    stay = lambda rows: corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    words = [f"{w}{k}" for k in range(8) for w in ("river", "stone", "light", "under", "carry", "morning", "window")]
    a, b, c, d = (" ".join(f"{x}{w}" for w in words) for x in "abcd")
    near = " ".join(c.split()[:-1])
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " and more"), (None, c), (None, c), (None, near), (None, d), (5, d), (None, None), (None, None), (7, None)]
    found = [(r.doc_id, r.text) for r in stay([(i, t, "en", "s") for i, t in rows])]
    assert sorted(x for x in found if x[0] not in (None, 7)) == [(1, a), (3, b + " and more"), (5, d)]
    assert found.count((7, None)) == found.count((None, None)) == 1
    assert [x[1] in (c, near) for x in found if x[0] is None and x[1]] == [True] and len(found) == 6
    kept = [r.doc_id for r in stay(documents)]
    assert len(kept) == len(set(kept)) and documents[-2][0] in kept and kept.count(None) == 1


def test_names_and_sql():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert {"pipeline", *names} <= set(entry.queries()) and set(registry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, expected))
