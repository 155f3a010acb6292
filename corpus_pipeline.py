"""A training corpus from raw documents: language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined results: the language stage drops null and empty texts, as they have no
letter, and fills in null languages. Near-duplicates, repeated rows and rows without
an id among them, leave one row, of ties that with the longest text. The mixture
takes null sources as a source, and rows that share an id as often as one of them.
Packing gives each row that is left its pieces; a null id stays null. Texts of any
length are read whole. Empty tables give an empty result. Other columns may have any
name and are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import language, minhash, mixing, packing
from fathom.llm.storage import materialise

#: A text of which no language has this much is rejected; one that mixes two languages has more for the better one.
LEAST_SCORE = 0.35


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names of our own for all columns but those that stages use."""
    return docs.toDF(*(c if c in ("doc_id", "text", "lang", "source") else f"extra{k}" for k, c in enumerate(docs.columns)))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that look like no language more than others; fills in missing languages."""
    plain = _plain(docs)
    found = language.predict(plain, language.train(plain))
    rejected = (F.col("lang_pred") == language.UNKNOWN) | (F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    return found.where(~rejected).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the least id, of each component of near-duplicates.

    Of rows that share that id the one with the longest text stays. Rows without an id are named by their text, so that
    their copies are found, too; these names come after other ids.
    """
    names, docs = docs.columns, _plain(docs)
    named = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    docs_named = docs.withColumn("d_name", F.coalesce(F.col("doc_id").cast("long"), named))
    found = minhash.near_duplicates(docs_named.select(F.col("d_name").alias("doc_id"), "text"))
    marks = found.groupBy(F.col("doc_id").alias("d_name")).agg(F.count("*").alias("d_rows"), F.min("kept").alias("d_kept"))
    marks = materialise(marks.where(~F.col("d_kept") | (F.col("d_rows") > 1)), "marks")
    single = docs_named.join(marks.select("d_name"), "d_name", "left_anti").select(*docs.columns)
    repeated = docs_named.join(marks.where("d_kept").select("d_name"), "d_name", "left_semi")
    longest = F.struct(F.coalesce(F.length("text"), F.lit(-1)), F.xxhash64(*docs.columns))
    one = repeated.groupBy("d_name").agg(F.max_by(F.struct(*docs.columns), longest).alias("d_row"))
    return single.unionByName(one.select("d_row.*")).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; the one on a target's edge stays if half of it is taken."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, F.lit(2.0)).otherwise(F.lit(1.0)).alias("weight"))
    names, docs = docs.columns, _plain(docs)
    mixed = mixing.mix(docs, quality=quality)
    copies = (F.col("epochs") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")).cast("int")
    # Rows that share an id share their copies, too.
    mixed = mixed.groupBy(F.col("doc_id").alias("m_id")).agg(F.max(copies).alias("m_copies"))
    mixed = mixed.where(F.col("m_copies") > 0)
    taken = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col("m_id")))
    return taken.withColumn("m_copy", F.explode(F.array_repeat(F.lit(0), F.col("m_copies")))).select(*docs.columns).toDF(*names)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences with their ids and steps."""
    pieces = packing.pack(docs)
    return pieces.join(packing.balance_steps(pieces), "sequence_id")


STAGES = [
    ("language", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_documents),
]

#: Packing and language identification are beyond SQL; the stages' tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
