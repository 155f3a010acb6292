"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch is a table of signed rows: +1 for a document that comes, -1 for one that
goes, both for one whose count is revised. Its sums are written under the batch's
name; a batch that is there already is left alone, so a commit may be repeated
after any failure. Totals are the sums over all batches.

``compact`` writes a base: the sums of the base before and of the batches since,
with these batches' names. Batches that the newest base names are read from it
alone; the next compaction removes them and leaves a mark for each name, so what
is listed is bounded by the commits between two compactions. A base is written
under a name of its own and never changed: a batch that is committed meanwhile is
not in it and stays a batch, and of two compactions at once the one that holds
more is the newest. A reader that two compactions overtake finds a file missing
and fails; it never counts twice.

Defined results: a null text has no tokens but counts as a document; null
sources and languages are groups of their own; repeated rows count as often as
they occur; a group without documents and tokens isn't listed; an empty batch is
committed and changes nothing. Columns that the operator doesn't use may have
any name.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .memory import tidy
from .storage import fresh_path, materialise

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenRollup:
    """The totals under ``path``, which all executors share. A batch's name is that of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _there(self, kind: str, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{kind}/{name}/_SUCCESS"))

    def _whole(self, kind: str) -> list[str]:
        """Names of the finished tables of a kind."""
        if not self._fs.exists(self._at(f"{self.path}/{kind}")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{kind}"))]
        return sorted(n for n in names if self._there(kind, n))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: source, lang, version, tokens, sign. False if the batch is there already."""
        if self._there("batches", batch) or self._fs.exists(self._at(f"{self.path}/done/{batch}")):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _newest(self) -> str | None:
        """Bases are named by their number and how many batches they add."""
        return max(self._whole("bases"), default=None)

    def _snapshot(self) -> tuple[str | None, list[str], list[str]]:
        """The newest base, the batches that it names, and those that came since: all of one moment."""
        while True:
            base = self._newest()
            batches = self._whole("batches")
            if base == self._newest():
                break
        held = self.spark.read.parquet(f"{self.path}/bases/{base}").where("batch IS NOT NULL").select("batch").collect() if base else []
        named = {r[0] for r in held}
        return base, sorted(named), [b for b in batches if b not in named]

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], SCHEMA)
        if batches:
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/batches/{b}" for b in batches)))
        if base:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/bases/{base}").where("batch IS NULL").drop("batch"))
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        base, _, batches = self._snapshot()
        return self._sums(base, batches)

    def compact(self) -> None:
        base, held, batches = self._snapshot()
        for name in held:
            self._fs.create(self._at(f"{self.path}/done/{name}"), True).close()
            self._fs.delete(self._at(f"{self.path}/batches/{name}"), True)
        if not batches:
            return
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        number = int(base.split("-")[0]) + 1 if base else 1
        rows = self._sums(base, batches).unionByName(names, allowMissingColumns=True)
        rows.write.parquet(f"{self.path}/bases/{number:012d}-{len(batches):09d}-{uuid.uuid4().hex}")


def version_of(path: str) -> str:
    return os.path.basename(path).rsplit(".", 1)[0]


def count_tokens(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """docs: text and any other columns. Adds a column of token counts for each tokenizer file, named ``n0``, ``n1`` and on.

    Files that are named alike on all executors; see ``tokens.counts``.
    """
    names = [f"n{k}" for k in range(len(paths))]
    kept = [c for c in docs.columns if c not in ("text", *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                found = [pa.array(tokens.counts(path, batch.column("text"))) for path in paths]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{n} long" for n in names)])
    return docs.select(*(F.col(f"`{c}`") for c in kept), "text").mapInArrow(tidy(run), ddl)


def signed(rows: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens"), F.lit(sign).alias("sign"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come, counted with one tokenizer; the toxic ones go; the good ones' counts are revised by another; a commit is repeated."""
    paths = [tokens.public_path(tokens.WORDS), tokens.public_path(tokens.BYTES)]
    old, new = map(version_of, paths)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    docs = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"), paths)
    docs = materialise(docs.join(labels, F.col("doc_id") == F.col("l_id"), "left"), "counts")
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    toxic = docs.where("toxic = 1")
    revised = docs.where("quality = 1 AND coalesce(toxic, 0) <> 1")
    rollup.commit("insert", signed(docs, old, "n0", 1))
    rollup.commit("delete", signed(toxic, old, "n0", -1))
    rollup.compact()
    rollup.commit("revise", signed(revised, old, "n0", -1).unionByName(signed(revised, new, "n1", 1)))
    rollup.compact()
    rollup.commit("delete", signed(toxic, old, "n0", -1))
    return rollup.totals()
