"""Readers of the engine's text formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.ranges import number
from fathom.functions.tokenize import tokens, words
from fathom.operators.features import Feature
from fathom.operators.rerank import Node


#: Most floats in a record of a file of static features.
BLOCK = 4096


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """docid, terms from lines ``docid<TAB>term term …``, plain or gzipped. Lines without a number are left out."""
    lines = spark.read.text(list(paths)).select(F.split("value", "\t", 2).alias("p"))
    rows = lines.select(F.col("p")[0].try_cast("long").alias("docid"), words(F.get("p", F.lit(1))).alias("terms"))
    return rows.where(F.col("docid").isNotNull())


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """at (from 0), value: lines in order, of several files by name. Splits of files are counted first, so a long one is read by many tasks."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", where.alias("split"), F.monotonically_increasing_id().alias("line"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = lines.groupBy("split").agg(F.count("*").alias("n")).select("split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("split").orderBy("line"))
    return lines.join(F.broadcast(starts), "split").select((F.col("start") + within - 1).alias("at"), "value")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, ord, term from a count and lines ``qid length term …``; of equal ids the last line counts."""
    rows = _numbered(spark, path).where("at > 0").select("at", F.split(F.trim("value"), r"\s+").alias("p"))
    rows = rows.select("at", F.col("p")[0].try_cast("int").alias("qid"), F.get("p", F.lit(1)).try_cast("int").alias("n"), "p").where("qid IS NOT NULL AND n IS NOT NULL")
    rows = rows.groupBy("qid").agg(F.max(F.struct("at", "n", "p")).alias("r"))
    return rows.select("qid", F.posexplode(F.slice("r.p", 3, F.col("r.n"))).alias("at", "term")).select("qid", (F.col("at") + 1).alias("ord"), "term")


def read_docnos(spark: SparkSession, path: str) -> DataFrame:
    """docid, docno: line by line, from 1."""
    return _numbered(spark, path).select((F.col("at") + 1).cast("long").alias("docid"), F.trim("value").alias("docno"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 4)
    return p.select(F.col("p")[0].try_cast("int").alias("qid"), F.col("p")[2].alias("docno"), F.col("p")[3].try_cast("int").alias("rel"))


def parse_features(lines: Iterable[str]) -> tuple[list[Feature], list[str]]:
    """Features and the paths of static ones: a count and a feature a line, a count and a path a line."""
    rest = [x.strip() for x in lines if x.strip()]
    count = int(rest[0])
    features = []
    for line in rest[1 : count + 1]:
        scorer, *parts = line.split()
        values = {k.lower(): float(v) for k, _, v in (p.partition(":") for p in parts) if v}
        kind = next(p for p in parts if ":" not in p)
        features.append(
            Feature(scorer, kind, k1=values.get("k1", 0.0), b=values.get("b", 0.0), mu=values.get("mu", 0.0), gap=int(values.get("gap", 0)), window=int(values.get("window", 0)))
        )
    more = rest[count + 1 :]
    return features, more[1 : int(more[0]) + 1] if more else []


def read_static(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """docid (from 1), name: from a file of little-endian 32-bit floats.

    The file is read in records of equal length, as long as its size allows up to
    ``BLOCK`` floats, by as many tasks as it has splits; none holds the whole file.
    """
    import numpy as np
    import pyarrow as pa

    whole = spark.read.format("binaryFile").load(path).select("length").first()  # none if it is empty
    size = whole[0] if whole else 0
    if size % 4:
        raise ValueError(f"{path} isn't a file of 32-bit floats")
    count = size // 4
    if not count:
        return spark.createDataFrame([], f"docid long, {name} float")
    each = next(n for n in range(min(BLOCK, count), 0, -1) if count % n == 0)

    def run(batches):
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            values = [np.frombuffer(b, dtype="<f4") for b in blocks]
            ids = [at * each + np.arange(1, each + 1) for at in batch.column("at").to_pylist()]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(values))], names=["docid", name])

    # Records of a fixed length are what the RDD reader alone can split a binary file into.
    records = spark.sparkContext.binaryRecords(path, 4 * each).map(bytearray).zipWithIndex()
    return spark.createDataFrame(records, "block binary, at long").mapInArrow(run, f"docid long, {name} float")


def parse_trees(lines: Iterable[str]) -> list[Node]:
    """A count of trees; each has a depth and lines root, node and leaf up to ``end``. Features count from 0."""
    rest = iter(x.split() for x in lines if x.strip())
    trees = []
    for _ in range(int(next(rest)[0])):
        next(rest)  # the depth follows from the nodes
        inner: dict[str, tuple[int, float]] = {}
        below: dict[tuple[str, bool], str] = {}
        leaves: dict[str, float] = {}
        top = None
        for kind, *p in rest:
            if kind == "end":
                break
            if kind == "root":
                top = p[0]
                inner[top] = abs(int(p[1])), float(p[2])
            elif kind == "node":
                inner[p[0]] = abs(int(p[2])), float(p[4])
                below[p[1], p[3] == "1"] = p[0]
            elif kind == "leaf":
                leaves[p[0]] = float(p[3])
                below[p[1], p[2] == "1"] = p[0]
            else:
                raise ValueError(f"unknown line: {kind}")

        def build(name: str, inner=inner, below=below, leaves=leaves) -> Node:
            if name in leaves:
                return Node(value=leaves[name])
            feature, threshold = inner[name]
            return Node(0.0, feature, threshold, build(below[name, True]), build(below[name, False]))

        trees.append(build(top))
    return trees


TAGS = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]*>")


def parse_pages(pages: DataFrame) -> DataFrame:
    """docid, terms of web pages: scripts, styles and tags go; page_id + 1 is the document id."""
    text = F.coalesce("html", F.lit(""))
    for pattern in TAGS:
        text = F.regexp_replace(text, pattern, " ")
    return pages.select((F.col("page_id") + 1).alias("docid"), tokens(text).alias("terms"))


def parse_messages(messages: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """docid, terms of short messages, numbered from 1 in the order of their ids; a message without tokens leaves a gap."""
    m = messages.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), tokens(F.col(text_column)).alias("terms"))
    return number(m, "id", name="docid").select("docid", "terms").where(F.size("terms") > 0)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """docid, terms from JSON statuses with id and text."""
    return parse_messages(spark.read.schema("id long, text string").json(path))


def read_archive(spark: SparkSession, path: str, docnos: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """docid, terms from WARC or TREC-web files, plain or gzipped, in any depth of folders.

    kind: warc or trec, for all files; without, as the first line of one of them
    says. A record is found by the line that starts it, so files are read once, in
    records and not whole. The number comes from docnos (docid, docno) or, without,
    is the number in the record's own id.
    """
    files = spark.read.option("recursiveFileLookup", "true")
    if kind is None:
        first = files.text(path).where(F.trim("value") != "").first()
        kind = "warc" if first and first[0].startswith("WARC/") else "trec"
    if kind not in ("warc", "trec"):
        raise ValueError("kind must be warc or trec")
    raw = files.option("lineSep", "\nWARC/" if kind == "warc" else "\n<DOC>").text(path).select(F.col("value").alias("r"))
    if kind == "warc":
        found = raw.select(F.trim(F.regexp_extract("r", r"(?m)^WARC-TREC-ID:\s*(\S+)", 1)).alias("docno"), F.regexp_replace("r", r"(?s)^.*?\r?\n\r?\n(HTTP/.*?\r?\n\r?\n)?", "").alias("html"))
    else:
        found = raw.select(F.trim(F.regexp_extract("r", r"<DOCNO>\s*(\S+?)\s*</DOCNO>", 1)).alias("docno"), F.regexp_replace("r", r"(?s)^.*?</DOCHDR>|^.*?</DOCNO>|</DOC>\s*$", "").alias("html"))
    found = found.where(F.col("docno") != "")
    if docnos is not None:
        found = found.join(docnos, "docno")
    else:
        found = found.withColumn("docid", F.regexp_replace("docno", r"\D+", "").try_cast("long"))
    return parse_pages(found.select((F.col("docid") - 1).alias("page_id"), "html"))
