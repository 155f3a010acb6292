"""Output formats: sets, feature vectors, runs, and documents as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.ranges import range_of


def with_docno(found: DataFrame, docnos: DataFrame | None) -> DataFrame:
    """Adds docno, the number itself where there is none."""
    if docnos is None:
        return found.withColumn("docno", F.col("docid").cast("string"))
    return found.join(docnos, "docid", "left").withColumn("docno", F.coalesce("docno", F.col("docid").cast("string")))


def set_lines(found: DataFrame, docnos: DataFrame | None = None) -> DataFrame:
    return with_docno(found, docnos).select("qid", "docid", F.concat_ws(" ", "qid", "docno").alias("line"))


def fixed(value: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def vector_lines(vectors: DataFrame, docnos: DataFrame | None = None) -> DataFrame:
    names = sorted((c for c in vectors.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    parts = [F.concat(F.lit(f"{i}:"), fixed(F.col(c))) for i, c in enumerate(names, 1)]
    return with_docno(vectors, docnos).select("qid", "docid", F.concat_ws(" ", "qid", "docno", *parts).alias("line"))


def run_lines(ranked: DataFrame, docnos: DataFrame | None = None, tag: str = "fathom") -> DataFrame:
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "docno", "rank", fixed(F.col("score")), F.lit(tag))
    return with_docno(ranked, docnos).select("qid", "rank", line.alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Text files; in order over all of them if an order is given."""
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("overwrite").text(path)


def write_documents(vectors: DataFrame, path: str, partitions: int | None = None) -> None:
    """``docid<TAB>term term …``, gzipped, in ranges of ids."""
    n = partitions or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are found from the ids alone, so that terms are made once; they move as lines.
    line = F.concat_ws("\t", "docid", F.array_join("terms", " ")).alias("value")
    rows = vectors.select("docid", line, range_of(vectors, "docid", n).alias("range"))
    rows.repartitionById(n, "range").sortWithinPartitions("docid").select("value").write.mode("overwrite").text(path, compression="gzip")


def write_queries(queries: DataFrame, path: str) -> None:
    """queries: qid, ord, term. A count, then ``qid length term …``, in order over all files."""
    rows = queries.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", "term"))).alias("t"))
    lines = rows.select(F.lit(1).alias("kind"), "qid", F.concat_ws(" ", "qid", F.size("t"), F.array_join("t.term", " ")).alias("line"))
    count = rows.agg(F.count("*").alias("n")).select(F.lit(0).alias("kind"), F.lit(0).alias("qid"), F.col("n").cast("string").alias("line"))
    write_lines(lines.unionByName(count), path, ["kind", "qid"])


def write_docnos(docnos: DataFrame, path: str) -> None:
    """docnos: docid (from 1, without gaps), docno. A line each, in order over all files."""
    write_lines(docnos.select("docid", F.col("docno").alias("line")), path, ["docid"])


def write_trec(pages: DataFrame, path: str) -> None:
    """pages: page_id, url, html. Records between <DOC> and </DOC>; their numbers are page_id + 1."""
    head = F.concat(F.lit("<DOC>\n<DOCNO>"), F.col("page_id") + 1, F.lit("</DOCNO>\n<DOCHDR>\n"), F.coalesce("url", F.lit("")), F.lit("\n</DOCHDR>\n"))
    pages.select(F.concat(head, F.coalesce("html", F.lit("")), F.lit("\n</DOC>")).alias("value")).write.mode("overwrite").text(path)
