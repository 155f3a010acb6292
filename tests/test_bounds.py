"""Top-k by bounds against the plain one, and what is read in parts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fathom import cli
from fathom.operators import candidates
from fathom.plans import index as ix
from fathom.sources import readers, sinks


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """400 documents; some terms are in more than half of them, some documents are equal."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    rows = [(k, draw.choices(words, weights, k=draw.randint(1, 40))) for k in range(1, 351)]
    rows += [(k, rows[k % 7][1]) for k in range(351, 401)] + [(401, [])]
    path = str(tmp_path_factory.mktemp("bounds") / "index")
    return ix.create_index(spark.createDataFrame(rows, "docid long, terms array<string>"), path, "tf", 0)


@pytest.mark.parametrize("hits", [1, 10, 60, 1000])
def test_bounds_change_no_rows(spark, index, hits):
    """Frequent, rare, repeated and unknown terms, and terms of negative idf alone."""
    asked = ["w0", "w0 w1", "w0 w30", "w39 w0 w1 w2", "w5 w5 w0 w20", "nosuch", "w3 w7 w11 w15 w19 w23", "w38 w37 w36 nosuch w0 w0 w0"]
    rows = [(q, i, t) for q, text in enumerate(asked, 1) for i, t in enumerate(text.split(), 1)]
    queries = spark.createDataFrame(rows, "qid int, ord int, term string")
    plain = {tuple(r) for r in candidates.bm25_top(index, queries, hits).collect()}
    assert {tuple(r) for r in candidates.bounded_bm25_top(index, queries, hits).collect()} == plain and plain


@pytest.mark.parametrize("count", [0, 1, 4096, 9973, 30000])
def test_static_values_of_any_number(spark, tmp_path, count):
    values = np.arange(count, dtype="<f4") / 8
    (tmp_path / "s").write_bytes(values.tobytes())
    found = {r.docid: r.s0 for r in readers.read_static(spark, str(tmp_path / "s"), "s0").collect()}
    assert found == {k + 1: float(v) for k, v in enumerate(values)}


def test_static_values_are_whole(spark, tmp_path):
    (tmp_path / "s").write_bytes(b"12345")
    with pytest.raises(ValueError):
        readers.read_static(spark, str(tmp_path / "s"))


def test_lines_of_many_files_are_numbered_by_name(spark, tmp_path):
    rows = [(k, f"d{k:04}") for k in range(1, 501)]
    random.Random(1).shuffle(rows)
    sinks.write_docnos(spark.createDataFrame(rows, "docid long, docno string").repartition(4), str(tmp_path / "n"))
    found = readers.read_docnos(spark, str(tmp_path / "n")).collect()
    assert {tuple(r) for r in found} == set(rows)


def test_each_query_has_its_time(spark, tmp_path, capsys, index):
    (tmp_path / "q").write_text("2\n1 2 w0 w1\n7 1 w3\n")
    ix.save_index(index, str(tmp_path / "i"))
    cli.run(spark, cli.parser().parse_args(["retrieve", "--index", str(tmp_path / "i"), "--query", str(tmp_path / "q"), "--algorithm", "WAND", "--each"]))
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[-1] for x in lines] == ["2", "1"] and all(float(x.split()[0]) > 0 for x in lines)
