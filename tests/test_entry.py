from __future__ import annotations

import os
import random

import pytest

import __spark_entry__ as entry
from fathom.operators import candidates
from fathom.plans import registry
from fathom.plans.workspace import corpus, topics

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", ["dictionary", "postings_positional", "svs_and", "wand_bm25_topk", "bwand_or_topk", "feature_vectors", "lambdamart_rerank", "parse_messages", "bloom_blocks", "bwand_and_bloom"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, expected))


@needs_tables
def test_invariants(spark):
    i, q = corpus(spark, SF), topics(spark, SF)
    exact = {tuple(r) for r in candidates.conjunction(i, q).collect()}
    rows = q.collect()
    random.Random(1).shuffle(rows)
    mixed = spark.createDataFrame([(r.qid, k, r.term) for k, r in enumerate(rows)], "qid long, ord int, term string")
    assert {tuple(r) for r in candidates.conjunction(i, mixed).collect()} == exact
    assert {tuple(r) for r in candidates.semi_conjunction(i, q).collect()} == exact
    assert exact <= {tuple(r) for r in registry.queries()["bwand_and_bloom"](spark, SF).collect()}
    sums = i.postings.selectExpr("sum(tf)").first()[0], i.term_stats.selectExpr("sum(cf)").first()[0], i.stats.first().total_len
    assert len(set(sums)) == 1
    told = registry.queries()["bloom_membership"](spark, SF)
    there = i.postings.join(i.searchable().select("term"), "term", "left_semi").select("term", "docid")
    assert told.join(there, ["term", "docid"]).where("NOT inside").count() == 0
