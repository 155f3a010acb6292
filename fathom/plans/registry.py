"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.operators import access, bloom, candidates, features, rerank
from fathom.plans import index as ix
from fathom.plans.oracle import SQL
from fathom.plans.workspace import corpus, documents, scratch, static_features, topics
from fathom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]

HITS = 10
CANDIDATES = 100
LOOKED_UP = ("the", "of", "and", "nosuchterm")

SPEC = """8
BM25 K1:0.5 B:0.3 Term
Dirichlet MU:1000 Term
BM25 K1:0.5 B:0.3 OD gap:0
BM25 K1:1.2 B:0.75 OD gap:8
Dirichlet MU:1000 OD gap:8
BM25 K1:0.5 B:0.3 UW window:4
BM25 K1:1.2 B:0.75 UW window:16
Dirichlet MU:1000 UW window:8
0"""

MODEL = """3
2
root 1 0 4.0
node 3 1 1 0 -8.0
leaf 2 1 1 0.1
leaf 4 3 1 0.2
leaf 5 3 0 0.3
end
2
root 1 3 0.5
node 2 1 7 1 -20.0
leaf 4 2 1 -0.5
leaf 5 2 0 -0.1
leaf 3 1 0 0.5
end
1
root 1 8 0.5
leaf 2 1 1 0.0
leaf 3 1 0 0.25
end"""

FEATURES = readers.parse_features(SPEC.splitlines())[0]


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


def dictionary(spark, d):
    return ix.dictionary(documents(spark, d))


def doc_stats(spark, d):
    return ix.build_index(documents(spark, d)).doc_stats


def collection_stats(spark, d):
    s = ix.build_index(documents(spark, d)).stats
    return s.select("n_docs", "total_len", F.round("avgdl", 4).alias("avgdl"), "default_df", "default_cf", F.round("default_idf", 4).alias("default_idf"))


def term_stats(spark, d):
    return ix.build_index(documents(spark, d), "tf").term_stats.select("term", "df", "cf")


def postings_docids(spark, d):
    return ix.build_index(documents(spark, d), "docids").postings.select("term", "docid")


def postings_tf(spark, d):
    return ix.build_index(documents(spark, d), "tf").postings.select("term", "docid", "tf")


def postings_positional(spark, d):
    return ix.build_index(documents(spark, d)).postings.select("term", "docid", "tf", _joined("positions"))


def term_upper_bound(spark, d):
    i = corpus(spark, d)
    t = i.searchable().crossJoin(F.broadcast(i.stats.select("avgdl")))
    bound = scoring.bm25(F.col("max_tf"), F.col("max_tf_dl"), F.col("avgdl"), F.col("idf"))
    return t.select("term", F.col("max_tf").cast("long").alias("max_tf"), F.col("max_tf_dl").cast("long").alias("max_tf_dl"), F.round(bound, 4).alias("upper_bound"))


def doc_vectors(spark, d):
    return documents(spark, d).select("docid", _joined("terms"))


def _terms(spark, terms: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def term_lookup(spark, d):
    return access.lookup_terms(ix.dictionary(documents(spark, d)), _terms(spark, LOOKED_UP))


def postings_lookup(spark, d):
    return access.postings_of(corpus(spark, d), "the").select("docid", "tf")


def vocab_df(spark, d):
    return access.vocabulary(corpus(spark, d))


def doc_vector_lookup(spark, d):
    ids = spark.createDataFrame([(1,), (7,), (100,), (10**9,)], "docid long")
    return access.vectors_of(corpus(spark, d), ids).select("docid", _joined("terms"))


def resolve_query_terms(spark, d):
    return access.resolve(corpus(spark, d), topics(spark, d)).select("qid", "ord", "term", "df", F.round("idf", 4).alias("idf"))


def rarest_term(spark, d):
    return access.rarest(access.resolve(corpus(spark, d), topics(spark, d))).select("qid", "term", "df")


def query_positions(spark, d):
    i, q = corpus(spark, d), topics(spark, d)
    pairs = candidates.conjunction(i, q)
    return access.query_positions(i, q, pairs).select("qid", "term", "docid", "tf", _joined("positions"))


def svs_and(spark, d):
    return candidates.conjunction(corpus(spark, d), topics(spark, d))


def svs_and_topk(spark, d):
    return candidates.conjunction(corpus(spark, d), topics(spark, d), HITS)


def svs_recent(spark, d):
    from dataclasses import replace

    return candidates.conjunction(replace(corpus(spark, d), reverse=True), topics(spark, d), HITS)


def intersect_two_terms(spark, d):
    return candidates.intersection(corpus(spark, d), "the", "of")


def bwand_and(spark, d):
    return candidates.semi_conjunction(corpus(spark, d), topics(spark, d))


def wand_bm25_topk(spark, d):
    return candidates.bm25_top(corpus(spark, d), topics(spark, d), HITS)


def wand_bm25_long_topk(spark, d):
    return candidates.bm25_top(corpus(spark, d), topics(spark, d, None), HITS)


def wand_bounded_topk(spark, d):
    return candidates.bounded_bm25_top(corpus(spark, d), topics(spark, d), HITS)


def wand_bounded_long_topk(spark, d):
    return candidates.bounded_bm25_top(corpus(spark, d), topics(spark, d, None), HITS)


def mbwand_idf_topk(spark, d):
    return candidates.idf_top(corpus(spark, d), topics(spark, d), HITS)


def bwand_or_topk(spark, d):
    return candidates.rarest_top(corpus(spark, d), topics(spark, d), HITS)


def bloom_blocks(spark, d):
    return bloom.blocks(corpus(spark, d)).select("term", "block", "last", "n", _joined("filter"))


def bloom_membership(spark, d):
    i = corpus(spark, d)
    pairs = i.doc_stats.select(F.lit("the").alias("term"), "docid").unionByName(i.doc_stats.select(F.lit("with").alias("term"), "docid"))
    # Filters of the terms asked for, of all their blocks.
    return bloom.membership(i, bloom.blocks(i, terms=_terms(spark, ("the", "with"))), pairs)


def bwand_and_bloom(spark, d):
    return bloom.bloom_conjunction(corpus(spark, d), topics(spark, d))


def idf(spark, d):
    return corpus(spark, d).term_stats.select("term", "df", F.round("idf", 4).alias("idf"))


def bm25_term_scores(spark, d):
    i = corpus(spark, d)
    terms = i.searchable().select("term", "idf").crossJoin(F.broadcast(i.stats.select("avgdl")))
    found = i.postings.select("term", "docid", "tf", "doc_len").join(terms, "term")
    return found.select("term", "docid", F.round(scoring.bm25(F.col("tf"), F.col("doc_len"), F.col("avgdl"), F.col("idf")), 4).alias("score"))


def _vectors(spark, d, chosen: list[features.Feature], static: bool = False, length: int | None = 4) -> DataFrame:
    i, q = corpus(spark, d), topics(spark, d, length)
    pairs = candidates.bm25_top(i, q, CANDIDATES)
    return features.extract(i, q, pairs, chosen, static_features(spark, d) if static else None)


def _feature(number: int) -> Query:
    def run(spark, d):
        return _vectors(spark, d, [FEATURES[number]]).select("qid", "docid", F.round("f1", 4).alias("value"))

    return run


def static(spark, d):
    pairs = access.held(candidates.bm25_top(corpus(spark, d), topics(spark, d), CANDIDATES))
    return pairs.select("qid", "docid").join(static_features(spark, d), "docid", "left").fillna(0.0, ["quality"]).select("qid", "docid", "quality")


def svs_and_long(spark, d):
    return candidates.conjunction(corpus(spark, d), topics(spark, d, None))


def mbwand_idf_long_topk(spark, d):
    return candidates.idf_top(corpus(spark, d), topics(spark, d, None), HITS)


def bwand_or_long_topk(spark, d):
    return candidates.rarest_top(corpus(spark, d), topics(spark, d, None), HITS)


def feature_vectors_long(spark, d):
    return feature_vectors(spark, d, None)


def lambdamart_rerank_long(spark, d):
    return rerank.rerank(feature_vectors(spark, d, None), readers.parse_trees(MODEL.splitlines()))


def feature_vectors(spark, d, length: int | None = 4):
    v = _vectors(spark, d, FEATURES, True, length)
    return v.select("qid", "docid", *[F.round(f"f{k}", 4).alias(f"f{k}") for k in range(1, 10)])


def lambdamart_rerank(spark, d):
    return rerank.rerank(feature_vectors(spark, d), readers.parse_trees(MODEL.splitlines()))


def _docnos(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") + 1).alias("docid"), F.concat_ws("-", F.upper("source"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("docno"))


def docno_join(spark, d):
    return sinks.with_docno(svs_and_topk(spark, d), _docnos(spark, d)).select("qid", "docid", "docno")


def trec_run(spark, d):
    return sinks.run_lines(wand_bm25_topk(spark, d), _docnos(spark, d))


def set_output(spark, d):
    return sinks.set_lines(mbwand_idf_topk(spark, d)).select("line")


def vector_lines(spark, d):
    return sinks.vector_lines(feature_vectors(spark, d))


def parse_pages(spark, d):
    return readers.parse_pages(spark.read.parquet(f"{d}/pages.parquet")).select("docid", _joined("terms"))


def parse_messages(spark, d):
    said = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return readers.parse_messages(said).select("docid", _joined("terms"))


def reverse_messages(spark, d):
    """The newest messages with both of two terms."""
    said = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    i = ix.build_index(readers.parse_messages(said), "tf", reverse=True)
    q = spark.createDataFrame([(1, 1, "the"), (1, 2, "of"), (2, 1, "de"), (2, 2, "la")], "qid int, ord int, term string")
    return candidates.conjunction(i, q, HITS)


def _written(spark, what: str, write: Callable[[str], None]) -> str:
    path = scratch(spark, what)
    write(path)
    return path


def _messages(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def line_files(spark, d):
    """Documents written as gzipped lines and read back."""
    path = _written(spark, "lines", lambda p: sinks.write_documents(documents(spark, d), p))
    return readers.read_lines(spark, path).select("docid", _joined("terms"))


def query_file(spark, d):
    path = _written(spark, "queries", lambda p: sinks.write_queries(topics(spark, d, None), p))
    return readers.read_queries(spark, path)


def docno_file(spark, d):
    path = _written(spark, "docnos", lambda p: sinks.write_docnos(_docnos(spark, d), p))
    return readers.read_docnos(spark, path)


def trec_files(spark, d):
    path = _written(spark, "trec", lambda p: sinks.write_trec(spark.read.parquet(f"{d}/pages.parquet"), p))
    return readers.read_archive(spark, path).select("docid", _joined("terms"))


def status_files(spark, d):
    path = _written(spark, "statuses", lambda p: _messages(spark, d).write.json(p))
    return readers.read_tweets(spark, path).select("docid", _joined("terms"))


def compacted_index(spark, d):
    """The postings of an index that was saved, rewritten and loaded."""
    path = _written(spark, "index", lambda p: ix.save_index(corpus(spark, d), p))
    return ix.compact(spark, path, scratch(spark, "compact")).postings.select("term", "docid", "tf")


def walked_rerank(spark, d):
    """The ensemble walked over batches, as large ones are."""
    return rerank.rerank(feature_vectors(spark, d), readers.parse_trees(MODEL.splitlines()), most_nodes=0)


def command_line(spark, d):
    """Indexing and retrieval by the command line's arguments, from files to a file."""
    from fathom import cli

    lines = _written(spark, "lines", lambda p: sinks.write_documents(documents(spark, d), p))
    asked = _written(spark, "queries", lambda p: sinks.write_queries(topics(spark, d), p))
    index, run = scratch(spark, "index"), scratch(spark, "run")
    cli.run(spark, cli.parser().parse_args(["index", "--index", index, "--type", "tf", "--input", lines]))
    cli.run(spark, cli.parser().parse_args(["retrieve", "--index", index, "--query", asked, "--algorithm", "WAND", "--hits", str(HITS), "--output", run]))
    return spark.read.text(run).select(F.col("value").alias("line"))


def queries() -> dict[str, Query]:
    plain = (
        dictionary, doc_stats, collection_stats, term_stats, postings_docids, postings_tf, postings_positional, term_upper_bound, doc_vectors,
        term_lookup, postings_lookup, vocab_df, doc_vector_lookup, resolve_query_terms, rarest_term, query_positions,
        svs_and, svs_and_topk, svs_recent, intersect_two_terms, bwand_and, wand_bm25_topk, wand_bm25_long_topk, wand_bounded_topk, wand_bounded_long_topk, mbwand_idf_topk, bwand_or_topk,
        bloom_blocks, bloom_membership, bwand_and_bloom, idf, bm25_term_scores, feature_vectors, svs_and_long, mbwand_idf_long_topk, bwand_or_long_topk, feature_vectors_long, lambdamart_rerank_long, lambdamart_rerank,
        line_files, query_file, docno_file, trec_files, status_files, compacted_index, walked_rerank, command_line,
        docno_join, trec_run, set_output, vector_lines, parse_pages, parse_messages, reverse_messages,
    )
    named = {
        "feature_term_bm25": 0, "feature_term_dirichlet": 1, "feature_od_bm25": 3, "feature_od_dirichlet": 4, "feature_uw_bm25": 6, "feature_uw_dirichlet": 7,
    }
    return {f.__name__: f for f in plain} | {name: _feature(k) for name, k in named.items()} | {"static_features": static}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in queries()}
