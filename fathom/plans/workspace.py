"""Indexes that several queries of a session share, saved as tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.tokenize import tokens
from fathom.plans.index import Index, create_index, load_index, tokenized

_saved: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, deleted when the driver ends; one of our own where that is unset and all tasks are this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fathom-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docid (from 1), terms."""
    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") + 1, F.col("text"))


def corpus(spark: SparkSession, sf_dir: str) -> Index:
    """The positional index of all documents, built once a session."""
    key = spark.sparkContext.applicationId, sf_dir, "documents"
    if key not in _saved:
        path = scratch(spark, "index")
        create_index(documents(spark, sf_dir), path)
        _saved[key] = path
    return load_index(spark, _saved[key])


def topics(spark: SparkSession, sf_dir: str, length: int | None = 4) -> DataFrame:
    """qid, ord, term: the first tokens of each benchmark item, or all of them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), tokens(F.col("text")).alias("terms"))
    if length is not None:
        items = items.withColumn("terms", F.slice("terms", 1, length))
    return items.select("qid", F.posexplode("terms").alias("at", "term")).select("qid", (F.col("at") + 1).alias("ord"), "term")


def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.groupBy((F.col("doc_id") + 1).alias("docid")).agg(F.max("quality").cast("double").alias("quality"))
