"""What moves between tasks: postings once, and no tokens."""

from __future__ import annotations

import gzip
import random
import subprocess
import sys
from collections import defaultdict
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fathom.operators import access, bloom, candidates, features
from fathom.plans import index as ix
from fathom.plans import registry
from fathom.sources import sinks
from tests.test_hand_corpus import asked

draw = random.Random(5)
TEXTS = {k: draw.choices([f"w{j}" for j in range(30)], [1 / (j + 1) for j in range(30)], k=draw.randint(0, 60)) for k in range(1, 301)}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("growth") / "index")
    return ix.create_index(spark.createDataFrame(list(TEXTS.items()), "docid long, terms array<string>"), path, df_cutoff=0, partitions=7)


def last_plan(df) -> str:
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_tokens_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "docid long, terms array<string>").write.parquet(str(tmp_path / "v"))
    assert "hashpartitioning(term" not in last_plan(ix.build_index(spark.read.parquet(str(tmp_path / "v"))).postings)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("kind", ix.TYPES)
def test_postings_are_those_of_loops_and_in_order_over_files(spark, tmp_path, kind, reverse):
    """One document without terms, one with a null term, one id twice."""
    rows = [*TEXTS.items(), (500, ["w1", None, "w1"]), (501, ["w3"]), (501, ["w3", "zz"])]
    vectors = spark.createDataFrame(rows, "docid long, terms array<string>")
    made = ix.create_index(vectors, str(tmp_path / "i"), kind, 0, reverse, True, 5)
    expected = defaultdict(int)
    for docid, terms in rows:
        for t in terms:
            expected[t, docid] += 1
    found = made.postings.collect()
    assert len(found) == len(expected)
    if kind == "docids":
        assert {(r.term, r.docid) for r in found} == set(expected)
    else:
        assert {(r.term, r.docid): r.tf for r in found} == expected
    if kind == "positional":
        at = {(r.term, r.docid): r.positions for r in found}
        assert at["w1", 500] == [1, 3] and at[None, 500] == [2]
        assert all(at[t, d] == [k for k, x in enumerate(TEXTS[d], 1) if x == t] for t, d in expected if d in TEXTS)
    ends = []
    for f in Path(tmp_path / "i" / "postings").glob("*.parquet"):
        keys = [(r["term"] or "", -r["docid"] if reverse else r["docid"]) for r in pq.read_table(f, columns=["term", "docid"]).to_pylist()]
        assert keys == sorted(keys)
        ends.append((min(k[0] for k in keys), max(k[0] for k in keys)))
    ends.sort()
    assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_a_few_terms_filters_are_made_for_a_few_terms(spark, monkeypatch):
    """bloom_membership made the filters of all terms."""
    seen, blocks = [], bloom.blocks
    monkeypatch.setattr(bloom, "blocks", lambda *a, **k: seen.append(k.get("terms")) or blocks(*a, **k))
    assert registry.queries()["bloom_membership"](spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(r[0] for r in seen[0].collect()) == ["the", "with"]


def test_filters_are_those_of_column_expressions(index):
    of = bloom.blocks(index)
    ids = index.postings.join(of, "term").where(F.col("docid") <= F.col("last"))
    assert ids.where(~bloom.contains(F.col("filter"), F.col("docid"), 3)).where("block = 0").count() == 0
    words = of.select("n", F.size("filter").alias("k"), F.aggregate("filter", F.lit(0), lambda a, w: a + F.bit_count(w)).alias("bits")).collect()
    assert all(r.k == -(-r.n * 8 // 32) and 0 < r.bits <= 3 * r.n for r in words)
    assert "Generate" not in of._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [candidates.bm25_top, candidates.bounded_bm25_top, candidates.idf_top, candidates.rarest_top, candidates.conjunction, candidates.semi_conjunction])
def test_postings_move_once_by_document(spark, index, made):
    plan = last_plan(made(index, asked(spark, "w0 w1 w20", "w3 w4 w0"), 10))
    assert "hashpartitioning(term" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("FileScan parquet") <= 1


def test_leaders_of_a_task(monkeypatch):
    rows = [(draw.randrange(5), d, draw.randrange(20) / 4) for d in range(5000)] + [(None, 1, 1.0), (1, None, 9.0), (1, 9999, None)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("qid", "docid", "score"), r)) for r in rows[k : k + 700]]) for k in range(0, len(rows), 700)]
    for most, reverse in ((1 << 20, False), (3, True)):
        monkeypatch.setattr(candidates, "MOST_HELD", most)
        found = [tuple(r.values()) for b in candidates._leaders(10, reverse)(iter(batches)) for r in b.to_pylist()]
        assert set(rows[-3:]) <= set(found)
        for q in range(5):
            best = sorted((r for r in rows[:-3] if r[0] == q), key=lambda r: (-r[2], -r[1] if reverse else r[1]))[:10]
            assert set(best) <= set(found)
        assert most == 3 or len(found) == 53


def test_positions_come_from_postings(spark, index):
    pairs = spark.createDataFrame([(1, 5), (2, 9)], "qid int, docid long")
    found = access.query_positions(replace(index, doc_vectors=None), asked(spark, "w0 w1", "w2"), pairs)
    expected = {(q, t, d): [k for k, x in enumerate(TEXTS[d], 1) if x == t] for q, d, ts in ((1, 5, ("w0", "w1")), (2, 9, ("w2",))) for t in ts}
    assert {(r.qid, r.term, r.docid): r.positions for r in found.collect()} == {k: v for k, v in expected.items() if v}


def test_candidates_are_found_once(spark, index):
    """Features read the candidates twice, so they were searched for twice."""
    queries = asked(spark, "w0 w1 w20", "w3 w4 w0")
    found = features.extract(index, queries, candidates.bm25_top(index, queries, 20), list(registry.FEATURES))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 40


@pytest.mark.parametrize("reverse", [False, True])
def test_a_file_of_several_parts_is_in_order(spark, tmp_path, monkeypatch, reverse):
    """A task holds a part's postings, not those of a file."""
    monkeypatch.setattr(ix, "PART", 200)
    test_postings_are_those_of_loops_and_in_order_over_files(spark, tmp_path, "positional", reverse)
    few = ix.create_index(spark.createDataFrame(list(TEXTS.items()), "docid long, terms array<string>"), str(tmp_path / "two"), partitions=2)
    assert len(list((tmp_path / "two" / "postings").glob("*.parquet"))) == 2 and few.postings.count() == sum(len(set(t)) for t in TEXTS.values())


def test_tasks_need_no_module_of_ours():
    for made in (ix._blocks([("a", 1)], True), ix._loose_blocks([("a", 1)], True), ix._unpacked(["term"], False)):
        subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"], input=cloudpickle.dumps(made), cwd="/", check=True)


@pytest.mark.parametrize("reverse", [False, True])
def test_saved_postings_are_rewritten_file_by_file(spark, tmp_path, monkeypatch, reverse):
    """All postings were sampled, shuffled and sorted again."""
    made = ix.create_index(spark.createDataFrame(list(TEXTS.items()), "docid long, terms array<string>"), str(tmp_path / "i"), reverse=reverse, partitions=7)
    files = lambda path: sorted((pq.read_table(f).to_pylist() for f in Path(path).glob("postings/*.parquet")), key=lambda t: (t[0]["term"], t[0]["docid"]))
    with monkeypatch.context() as m:
        m.setattr(ix, "_write_postings", None)
        n = len(made.postings.inputFiles())
        ix.save_index(made, str(tmp_path / "a"), n)
        ix.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), n)
        assert n > 3 and files(tmp_path / "i") == files(tmp_path / "a") == files(tmp_path / "b")
    # What isn't as it was saved is ordered anew.
    ix.save_index(replace(made, postings=made.postings.where("docid < 9")), str(tmp_path / "c"), n)
    assert ix.load_index(spark, str(tmp_path / "c")).postings.count() == made.postings.where("docid < 9").count()
    ix.save_index(replace(made, reverse=not reverse), str(tmp_path / "d"), 1)
    ids = [r.docid for r in ix.load_index(spark, str(tmp_path / "d")).postings.where("term = 'w0'").collect()]
    assert ids == sorted(ids, reverse=not reverse) and len(ids) > 9


def test_terms_of_written_lines_are_made_once(spark, tmp_path):
    """They were made to find the ranges of ids and once more to be written."""
    made = spark.sparkContext.accumulator(0)
    terms = F.udf(lambda k: made.add(1) or [f"w{k}", "x"], "array<string>")
    vectors = spark.range(1, 201, 1, 4).select((201 - F.col("id")).alias("docid"), terms("id").alias("terms"))
    sinks.write_documents(vectors, str(tmp_path / "lines"), 3)
    assert made.value == 200
    files = [[int(line.split("\t")[0]) for line in gzip.open(f, "rt")] for f in sorted((tmp_path / "lines").glob("*.gz"))]
    assert len(files) == 3 and sum(files, []) == list(range(1, 201))
