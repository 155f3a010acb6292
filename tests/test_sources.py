from __future__ import annotations

import gzip

import numpy as np
from pyspark.sql import functions as F

from fathom import cli
from fathom.operators import bloom
from fathom.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lines_plain_and_gzipped(spark, tmp_path):
    write(tmp_path / "a.txt", "1\ta b  c \n\nx\tbad\n2\t\n3\tlast line without end")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("4\td\n")
    found = {r.docid: r.terms for r in readers.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.gz")).collect()}
    assert found == {1: ["a", "b", "c"], 2: [], 3: ["last", "line", "without", "end"], 4: ["d"]}


def test_queries_keep_declared_lengths_and_the_last_of_equal_ids(spark, tmp_path):
    path = write(tmp_path / "q", "3\n7 2 a b c\n8 1 x\n7 2 b b\n")
    found = sorted(map(tuple, readers.read_queries(spark, path).collect()))
    assert found == [(7, 1, "b"), (7, 2, "b"), (8, 1, "x")]


def test_docnos_judgements_and_static_values(spark, tmp_path):
    path = write(tmp_path / "d", "CD-1\nCD-2\n")
    assert sorted(map(tuple, readers.read_docnos(spark, path).collect())) == [(1, "CD-1"), (2, "CD-2")]
    path = write(tmp_path / "j", "1 0 CD-2 1\n")
    assert [tuple(r) for r in readers.read_judgements(spark, path).collect()] == [(1, "CD-2", 1)]
    values = np.array([0.5, 1.5, -2.0], dtype="<f4")
    (tmp_path / "s").write_bytes(values.tobytes())
    assert {r.docid: r.value for r in readers.read_static(spark, str(tmp_path / "s")).collect()} == {1: 0.5, 2: 1.5, 3: -2.0}


def test_feature_spec():
    found, static = readers.parse_features("3\nBM25 B:0.3 K1:0.5 Term\nDirichlet MU:1000 OD gap:8\nBM25 K1:1 UW window:4\n1\n/x\n".splitlines())
    assert [(f.scorer, f.kind, f.k1, f.b, f.mu, f.gap, f.window) for f in found] == [
        ("BM25", "Term", 0.5, 0.3, 0, 0, 0), ("Dirichlet", "OD", 0, 0, 1000, 8, 0), ("BM25", "UW", 1, 0, 0, 0, 4)
    ]
    assert static == ["/x"]


def test_archives_and_messages(spark, tmp_path):
    (tmp_path / "w" / "x").mkdir(parents=True)
    warc = "WARC/0.18\nWARC-Type: warcinfo\n\ninfo\n"
    for n, word in ((1, "alpha"), (2, "beta")):
        warc += f"WARC/0.18\nWARC-Type: response\nWARC-TREC-ID: cw-{n}\n\nHTTP/1.1 200 OK\nA: b\n\n<html><script>no</script><p>{word} Text</p></html>\n"
    write(tmp_path / "w" / "x" / "a.warc", warc)
    found = {r.docid: r.terms for r in readers.read_archive(spark, str(tmp_path / "w")).collect()}
    assert found == {1: ["alpha", "text"], 2: ["beta", "text"]}
    trec = "".join(f"<DOC>\n<DOCNO>GX-{n}</DOCNO>\n<DOCHDR>\nhttp://x\n</DOCHDR>\n<b>{w}</b> more\n</DOC>\n" for n, w in ((5, "one"), (6, "two")))
    write(tmp_path / "t.trec", trec)
    docnos = spark.createDataFrame([(50, "GX-5"), (60, "GX-6")], "docid long, docno string")
    found = {r.docid: r.terms for r in readers.read_archive(spark, str(tmp_path / "t.trec"), docnos).collect()}
    assert found == {50: ["one", "more"], 60: ["two", "more"]}
    path = write(tmp_path / "m.json", '{"id": 5, "text": "Hi you"}\n{"id": 9, "text": "…"}\n{"id": 12}\n{"id": 20, "text": "ok"}\n')
    assert {r.docid: r.terms for r in readers.read_tweets(spark, path).collect()} == {1: ["hi", "you"], 3: ["ok"]}


def test_filters_by_bits(spark):
    """Against loops over plain numbers; ids beyond 32 bits are folded."""
    values = {int(v): k for k, v in enumerate([*range(7, 7 * 129, 7), 1 << 40])}
    prime = bloom.PRIME
    assert bloom.factors(3)[0] == (48271, 48271**2 % prime) and len({x for f in bloom.factors(9) for x in f}) == 18
    bits = lambda v: {((a * (v % prime) + b) % prime) % 1056 for a, b in bloom.factors(3)}
    whole = set().union(*map(bits, values))
    words = [sum(1 << (b % 32) for b in whole if b // 32 == w) for w in range(33)]
    asked = [*values, *range(1, 3000)]
    rows = spark.createDataFrame([(v, words) for v in asked], "docid long, words array<long>")
    found = rows.select("docid", bloom.contains(F.col("words"), F.col("docid"), 3).alias("inside")).collect()
    assert all(r.inside == (bits(r.docid) <= whole) for r in found)
    assert all(r.inside for r in found if r.docid in values) and sum(r.inside for r in found if r.docid not in values) < 300


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "docs", "1\ta b c a b\n2\tb a x b\n3\ta a c\n4\tc b\n5\tx x\n")
    write(tmp_path / "q", "1\n1 2 a b\n")
    write(tmp_path / "no", "\n".join(f"N{k}" for k in range(1, 6)) + "\n")
    write(tmp_path / "spec", "1\nBM25 K1:0.5 B:0.3 Term\n0\n")
    write(tmp_path / "model", "1\n1\nroot 1 0 0.5\nleaf 2 1 1 0.1\nleaf 3 1 0 0.9\nend\n")
    go = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    go("index", "--index", tmp_path / "i", "--type", "positional", "--vectors", "--df-cutoff", 0, "--input", tmp_path / "docs")
    go("compact", "--input", tmp_path / "i", "--output", tmp_path / "c")
    go("retrieve", "--index", tmp_path / "c", "--query", tmp_path / "q", "--output", tmp_path / "o", "--algorithm", "WAND", "--docnos", tmp_path / "no")
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert len(lines) == 4 and sum(x.startswith("1 Q0 N1 ") for x in lines) == 1 and all(x.endswith(" fathom") for x in lines)
    go("retrieve", "--index", tmp_path / "c", "--query", tmp_path / "q", "--output", tmp_path / "v", "--features", tmp_path / "spec", "--algorithm", "BWAND_AND", "--hashes", 3)
    assert all(r.value.split()[2].startswith("1:") for r in spark.read.text(str(tmp_path / "v")).collect())
    go("retrieve", "--index", tmp_path / "c", "--query", tmp_path / "q", "--output", tmp_path / "r", "--features", tmp_path / "spec", "--model", tmp_path / "model")
    assert all(" Q0 " in r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    capsys.readouterr()
    go("postings", "--index", tmp_path / "c", "--term", "x")
    assert sorted(capsys.readouterr().out.split()) == ["2:1", "5:2"]


def test_command_line_with_stems(spark, tmp_path, capsys):
    write(tmp_path / "docs", "1\tthe operations\n2\tthe operator computes\n3\tthe cats\n")
    write(tmp_path / "q", "2\n1 2 operate the\n2 1 the\n")
    write(tmp_path / "stop", "the\nof\n")
    go = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    words = ["--stop", tmp_path / "stop", "--stem"]
    go("index", "--index", tmp_path / "i", "--df-cutoff", 0, "--input", tmp_path / "docs", *words)
    go("retrieve", "--index", tmp_path / "i", "--query", tmp_path / "q", "--output", tmp_path / "o", *words)
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["1 1", "1 2"]
    capsys.readouterr()
    go("postings", "--index", tmp_path / "i")
    assert sorted(capsys.readouterr().out.splitlines()) == ["cat 1", "comput 1", "oper 2"]


def test_document_lines_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(2, ["b", "c"]), (1, ["a"])], "docid long, terms array<string>")
    sinks.write_documents(docs, str(tmp_path / "out"), 2)
    assert {r.docid: r.terms for r in readers.read_lines(spark, str(tmp_path / "out")).collect()} == {1: ["a"], 2: ["b", "c"]}


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path):
    path = write(tmp_path / "long", "".join(f"D-{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        found = readers.read_docnos(spark, path)
        assert sorted(map(tuple, found.collect())) == [(k + 1, f"D-{k}") for k in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_are_rows(spark, tmp_path):
    warc = "".join(f"WARC/0.18\r\nWARC-Type: response\r\nWARC-TREC-ID: cw-{n}\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>word{n} the\n<DOC> x</p>\n" for n in range(300))
    with gzip.open(tmp_path / "a.warc.gz", "wt", newline="") as f:
        f.write(warc)
    found = {r.docid: r.terms for r in readers.read_archive(spark, str(tmp_path / "a.warc.gz"), kind="warc").collect()}
    assert found == {n: [f"word{n}", "the", "x"] for n in range(300)}
    lines = spark.read.option("lineSep", "\nWARC/").text(str(tmp_path / "a.warc.gz"))
    assert lines.count() == 300


def test_outputs_name_documents_and_are_in_order(spark, tmp_path):
    docnos = spark.createDataFrame([(1, "N1"), (2, "N2")], "docid long, docno string")
    vectors = spark.createDataFrame([(1, 2, 0.5), (1, 1, 1.0), (1, 3, 2.0)], "qid int, docid long, f1 double")
    found = sinks.vector_lines(vectors, docnos)
    assert sorted(r.line for r in found.collect()) == ["1 3 1:2.000000", "1 N1 1:1.000000", "1 N2 1:0.500000"]
    sinks.write_lines(sinks.set_lines(vectors), str(tmp_path / "set"), ["qid", "docid"])
    assert [r.value for r in spark.read.text(str(tmp_path / "set")).collect()] == ["1 1", "1 2", "1 3"]
