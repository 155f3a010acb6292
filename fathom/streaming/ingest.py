"""Incremental indexing of a stream of documents.

Each micro-batch appends its postings, document lengths and vectors under its own
number; a batch that is repeated after a failure replaces its own folder, so
nothing is counted twice. Statistics are sums over what is there: scores are as
of the snapshot that a query takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.index import DF_CUTOFF, Index, build_index, collection_stats, save_index, term_stats

TABLES = ("postings", "doc_stats", "doc_vectors")
SCHEMAS = {
    "postings": "term string, docid long, tf int, doc_len long, positions array<int>",
    "doc_stats": "docid long, doc_len long",
    "doc_vectors": "docid long, terms array<string>",
}


class StreamIndex:
    """A growing positional index under ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, df_cutoff: int = DF_CUTOFF, reverse: bool = False):
        self.spark, self.path, self.df_cutoff, self.reverse = spark, path.rstrip("/"), df_cutoff, reverse

    def _read(self, table: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMAS[table] + ", batch long")
        return self.spark.read.schema(SCHEMAS[table] + ", batch long").parquet(f"{self.path}/{table}")

    def add(self, vectors: DataFrame, batch: int) -> None:
        """vectors: docid, terms. Documents that an earlier batch brought are left out, and repeats within the batch."""
        known = self._read("doc_stats").where(F.col("batch") != batch).select("docid")
        new = vectors.join(known, "docid", "left_anti").groupBy("docid").agg(F.min("terms").alias("terms"))
        at = lambda table: f"{self.path}/{table}/batch={batch}"
        new.select("docid", "terms").write.mode("overwrite").parquet(at("doc_vectors"))
        built = build_index(self.spark.read.schema(SCHEMAS["doc_vectors"]).parquet(at("doc_vectors")), df_cutoff=self.df_cutoff)
        for table in ("postings", "doc_stats"):  # the lengths last: what they name is there
            getattr(built, table).write.mode("overwrite").parquet(at(table))

    def snapshot(self) -> Index:
        postings, docs, vectors = (self._read(t).drop("batch") for t in TABLES)
        stats = collection_stats(docs)
        return Index(postings, term_stats(postings, stats), docs, stats, vectors, "positional", self.df_cutoff, self.reverse)

    def compact(self, target: str) -> None:
        """A saved index of all batches so far, ordered by term."""
        save_index(self.snapshot(), target)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Starts to index a streaming table of docid, terms."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table of docid, terms from lines ``docid<TAB>term term …`` of files that come into a folder."""
    from fathom.functions.tokenize import words

    lines = spark.readStream.text(path).select(F.split("value", "\t", 2).alias("p"))
    rows = lines.select(F.col("p")[0].try_cast("long").alias("docid"), words(F.get("p", F.lit(1))).alias("terms"))
    return rows.where(F.col("docid").isNotNull())
