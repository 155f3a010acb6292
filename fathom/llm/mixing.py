"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / weight`` with ``u`` drawn from the MD5 of
its id, so reruns agree. Each source has a target in words. Complete epochs over
the source come first; the rest of the target goes to the documents with the
smallest keys, found by prefix sums. Keys are cut into ranges, the ranges are
summed first, and only within a range are rows sorted, so that a source with a
third of all rows is spread over as many tasks as any other.

Defined results: a null text has size 0; a null source is a source of its own,
last in the order of sources; a null id is keyed by the empty string; repeated
rows are documents of their own; ties between keys go to the smaller id, then
the smaller size; an empty table gives an empty result. Columns that the
operator doesn't use may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str = "") -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes: skey, source, source_size, one row a source. Adds ``target``.

    The targets are min(cap * size, level * weight); the level that uses up the
    total is found with prefix sums over the sources in the order in which they
    reach their caps. The table has a row for each source, so one task sorts it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "total": F.lit(float(share)) * F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    full = F.col("total") - F.col("cap_before") >= F.col("cap") / F.col("weight") * (F.col("all_weight") - F.col("weight_before"))
    t = t.withColumn("full", full)
    t = t.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)),
        "open": F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0.0)),
    })
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("left") / F.col("open") * F.col("weight")))
    return t.select("skey", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    quality: DataFrame | None = None,
    seed: str = "",
    ranges: int = 1024,
) -> DataFrame:
    """docs: doc_id, source and text. Returns doc_id, source, size, source_size, target, taken.

    weights: of the sources in the order of their names, repeating. share: words
    of the mix as a multiple of all words. cap: most that a source gives, in
    multiples of its size. quality: doc_id, weight (over 0); documents without
    one weigh 1. ``taken`` counts the words that the mix takes of a document,
    repeats included; the document on the edge of the target gives a part.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").cast("double").alias("q_weight"))
        rows = rows.join(q, F.col("doc_id") == F.col("q_id"), "left")
        weight = F.coalesce(F.when(F.col("q_weight") > 0, F.col("q_weight")), F.lit(1.0))
    rows = rows.withColumn("key", sampling_key(F.col("doc_id"), weight, seed))
    near = F.floor(F.lit(float(ranges)) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")
    rows = materialise(rows.select(
        "doc_id", "source", "size", "key",
        F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit(""))).alias("skey"),
        F.least(near, F.lit(ranges - 1)).alias("range"),
    ), "sizes")
    by_range = rows.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    by_range = materialise(by_range, "ranges")
    sizes = by_range.groupBy("skey").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    words = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("skey", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    starts = starts.join(targets, "skey")
    within = Window.partitionBy("skey", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, ["skey", "range"])
    rows = rows.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size"))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", part.cast("long").alias("part"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; those labelled as good weigh twice as much."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, F.lit(2.0)).otherwise(F.lit(1.0)).alias("weight"))
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality=quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH q AS (SELECT doc_id AS q_id, max(CASE WHEN quality = 1 THEN 2e0 ELSE 1e0 END) AS weight FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS nosource,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0) / coalesce(weight, 1e0) AS key
  FROM documents LEFT JOIN q ON doc_id = q_id),
s AS (SELECT nosource, coalesce(source, '') AS name, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY 1, 2),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY nosource, name) - 1) % 3] AS DOUBLE) AS w, 2e0 * n AS cap FROM s),
o AS (
  SELECT *, 1.5e0 * sum(n) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(cap) OVER b, 0e0) AS cap_before, coalesce(sum(w) OVER b, 0e0) AS w_before
  FROM w WINDOW b AS (ORDER BY cap / w, nosource, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, total - cap_before >= cap / w * (ws - w_before) AS is_full FROM o),
g AS (SELECT *, total - coalesce(sum(cap) FILTER (is_full) OVER (), 0e0) AS rest_words, ws - coalesce(sum(w) FILTER (is_full) OVER (), 0e0) AS rest_w FROM f),
t AS (SELECT nosource, name, CAST(n AS BIGINT) AS source_size, CASE WHEN is_full THEN cap ELSE least(cap, rest_words / rest_w * w) END AS target FROM g),
u AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) AS words FROM t),
v AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM u),
p AS (
  SELECT d.doc_id, d.size, v.source_size, v.target, v.epochs, v.words - v.epochs * v.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.nosource, coalesce(d.source, '') ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN v ON d.nosource = v.nosource AND coalesce(d.source, '') = v.name)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(rest - start, 0), size) AS BIGINT) AS taken FROM p
"""
