"""Command line: ``python -m fathom.cli index|retrieve|postings|compact``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom.functions.tokenize import prepared
from fathom.operators import access
from fathom.plans import index as ix
from fathom.plans.retrieval import ALGORITHMS, retrieve
from fathom.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathom")
    to = p.add_subparsers(dest="command", required=True)
    a = to.add_parser("index", help="build an index from lines of a number, a tab and terms")
    a.add_argument("--index", required=True)
    a.add_argument("--type", choices=ix.TYPES, default="docids")
    a.add_argument("--reverse", action="store_true")
    a.add_argument("--vectors", action="store_true")
    a.add_argument("--df-cutoff", type=int, default=ix.DF_CUTOFF)
    a.add_argument("--partitions", type=int)
    a.add_argument("--input", nargs="+", required=True)
    a = to.add_parser("retrieve", help="answer a file of queries")
    a.add_argument("--index", required=True)
    a.add_argument("--query", required=True)
    a.add_argument("--output")
    a.add_argument("--hits", type=int)
    a.add_argument("--algorithm", choices=ALGORITHMS, default="SvS")
    a.add_argument("--hashes", type=int, help="ask Bloom filters with so many hash values (BWAND_AND)")
    a.add_argument("--docnos")
    a.add_argument("--features")
    a.add_argument("--model")
    a.add_argument("--tag", default="fathom")
    a.add_argument("--each", action="store_true", help="answer the queries one by one and show each one's microseconds and length; nothing is written")
    for name in ("index", "retrieve"):
        to.choices[name].add_argument("--stop", help="a file of stop words, one a line, that are left out")
        to.choices[name].add_argument("--stem", action="store_true", help="take Porter's stems of the terms")
    a = to.add_parser("postings", help="show a term's postings, or all terms")
    a.add_argument("--index", required=True)
    a.add_argument("--term")
    a.add_argument("--output")
    a = to.add_parser("compact", help="rewrite an index in order of terms")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--partitions", type=int)
    return p


def _file(spark: SparkSession, path: str) -> list[str]:
    """A configuration file's lines."""
    return spark.read.text(path, wholetext=True).first()[0].splitlines()


def _stop(spark: SparkSession, path: str | None) -> list[str]:
    return [w for w in map(str.strip, _file(spark, path)) if w] if path else []


def _static(spark: SparkSession, paths: list[str]):
    static = None
    for k, path in enumerate(paths):
        one = readers.read_static(spark, path, f"s{k}")
        static = one if static is None else static.join(one, "docid", "full")
    return static


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "index":
        lines = readers.read_lines(spark, *args.input).withColumn("terms", prepared(F.col("terms"), _stop(spark, args.stop), args.stem))
        ix.create_index(lines, args.index, args.type, args.df_cutoff, args.reverse, args.vectors, args.partitions)
    elif args.command == "retrieve":
        index, began = ix.load_index(spark, args.index), time.time()
        spec, paths = readers.parse_features(_file(spark, args.features)) if args.features else ([], [])
        model = readers.parse_trees(_file(spark, args.model)) if args.model else []
        docnos = readers.read_docnos(spark, args.docnos) if args.docnos else None
        queries = readers.read_queries(spark, args.query)
        if args.stop or args.stem:
            queries = queries.withColumn("term", F.explode(prepared(F.array("term"), _stop(spark, args.stop), args.stem)))
        static = _static(spark, paths)
        if args.each:
            for qid, length in queries.groupBy("qid").agg(F.count("*").alias("n")).orderBy("qid").toLocalIterator():
                began = time.time()
                one = retrieve(index, queries.where(F.col("qid") == qid), args.algorithm, args.hits, spec, static, model, args.hashes)[1]
                one.write.format("noop").mode("overwrite").save()
                print(f"{(time.time() - began) * 1e6:10.0f} length: {length}")
            return
        kind, found = retrieve(index, queries, args.algorithm, args.hits, spec, static, model, args.hashes)
        lines = sinks.run_lines(found, docnos, args.tag) if kind == "run" else sinks.vector_lines(found, docnos) if kind == "vectors" else sinks.set_lines(found, docnos)
        if args.output:
            sinks.write_lines(lines, args.output, ["qid", "rank"] if kind == "run" else ["qid", "docid"])
        else:
            lines.write.format("noop").mode("overwrite").save()
        print(f"{time.time() - began:.3f} s for {queries.select('qid').distinct().count()} queries")
    elif args.command == "postings":
        index = ix.load_index(spark, args.index)
        if args.term:
            found = access.postings_of(index, args.term)
            line = F.concat_ws(":", *(c for c in ("docid", "tf") if c in found.columns))
        else:
            found, line = access.vocabulary(index), F.concat_ws(" ", "term", "df")
        lines = found.select(line.alias("line"))
        if args.output:
            sinks.write_lines(lines, args.output)
        else:
            for row in lines.toLocalIterator():
                print(row[0])
    else:
        ix.compact(spark, args.input, args.output, args.partitions)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("fathom").getOrCreate(), args)


if __name__ == "__main__":
    main()
