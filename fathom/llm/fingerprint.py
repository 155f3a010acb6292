"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes marks where chunks may end; a strict mask holds
up to the normal chunk size and a loose one beyond it, which keeps sizes near the
normal one. Boundaries depend on the last 32 bytes only, so they move with the
text. A fingerprint is the set of the chunks' digests (40 bits) with their
lengths, in base64; the containment of two fingerprints is the length of the
chunks that both have by that of the smaller fingerprint.

Texts of any length are read a block at a time, so that only what is kept of a
chunk grows with the text.

Defined results: a null text is empty; an empty text has the empty fingerprint,
which is wholly contained in another empty one and not at all in others;
documents are ordered by id (null first), then by a hash of the text, then by the
text, so repeated rows follow each other; a table of one row is its own next
document; an empty table gives no rows. Columns that the operator doesn't use may
have any name. An id with a third of all rows is many tasks'; equal rows are one's.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import tidy
from .tokens import slices

BLOCK, REACH = 1 << 18, 31  # bytes of a text at a time; those before it that its marks depend on
PLACES = 1 << 30
LEAST, NORMAL, MOST = 16, 48, 192
STRICT, LOOSE = np.uint32(0x3F << 26), np.uint32(0xF << 28)
_rng = np.random.default_rng(20)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
RATIO = 0x9E3779B97F4A7C15
INVERSE = pow(RATIO, -1, 1 << 64)
_powers = np.ones((2, 1), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of RATIO and of INVERSE modulo 2**64, n of each at least."""
    global _powers
    while _powers.shape[1] < n:
        k = _powers.shape[1]
        step = np.array([[pow(RATIO, k, 1 << 64)], [pow(INVERSE, k, 1 << 64)]], dtype=np.uint64)
        _powers = np.concatenate((_powers, _powers * step), axis=1)
    return _powers


def _marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a chunk may end by the loose mask, and by both; a block of the text at a time."""
    loose: list[int] = []
    strict: list[int] = []
    for low in range(0, len(data), BLOCK):
        before = max(0, low - REACH)
        h = GEAR[data[before : low + BLOCK]]
        for k in (1, 2, 4, 8, 16):  # after this, a hash of the last 32 bytes
            h[k:] += h[:-k] << np.uint32(k) if k < len(h) else 0
        h = h[low - before :]
        at = np.flatnonzero((h & LOOSE) == 0)
        tight = (h[at] & STRICT) == 0
        at += low + 1
        loose += at.tolist()
        strict += at[tight].tolist()
    return loose, strict


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of ``data`` (unsigned bytes)."""
    n = len(data)
    ends, strict = _marks(data)
    ends.append(n + MOST)
    strict.append(n + MOST)
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        low, mid, high = at + LEAST, at + NORMAL, min(at + MOST, n)
        while strict[i] < low:
            i += 1
        if strict[i] < mid:
            at = min(strict[i], n)
        else:
            while ends[j] < mid:
                j += 1
            at = min(ends[j], high)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def segment_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial sums of the bytes of each segment; both bounds ascend. A block of the text at a time, whatever the segments' lengths."""
    up, down = powers(min(len(raw), BLOCK) + 1)
    if len(raw) <= BLOCK:
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(VALUE[raw] * up[: len(raw)], dtype=np.uint64)))
        return (sums[ends] - sums[starts]) * down[starts]
    low, high, back = (np.zeros(len(starts), dtype=np.uint64) for _ in range(3))
    before = np.zeros(1, dtype=np.uint64)
    for o in range(0, len(raw), BLOCK):
        part = raw[o : o + BLOCK]
        sums = np.cumsum(VALUE[part] * up[: len(part)], dtype=np.uint64)
        if o:
            sums = sums * np.uint64(pow(RATIO, o, 1 << 64)) + before
        sums = np.concatenate((before, sums))
        i, j = np.searchsorted(starts, (o, o + len(part)))
        low[i:j] = sums[starts[i:j] - o]
        back[i:j] = down[starts[i:j] - o] * np.uint64(pow(INVERSE, o, 1 << 64))
        i, j = np.searchsorted(ends, (o + 1, o + len(part) + 1))
        high[i:j] = sums[ends[i:j] - o]
        before = sums[-1:]
    return (high - low) * back


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct chunks' digests (40 bits, with the length in the 8 bits below), sorted, and their lengths."""
    if not data:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.array(boundaries(raw), dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    d = segment_sums(raw, starts, ends)
    d = (d ^ (d >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.unique((d >> np.uint64(24)) << np.uint64(8) | (ends - starts).astype(np.uint64))
    return key, (key & np.uint64(0xFF)).astype(np.int64)


def encode(keys: np.ndarray) -> str:
    return base64.b64encode(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), dtype=np.uint8), raw), axis=1).copy().view(">u8").reshape(-1).astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = np.intersect1d(a, b, assume_unique=True) & np.uint64(0xFF)
    return float(common.sum()) / float(min((a & np.uint64(0xFF)).sum(), (b & np.uint64(0xFF)).sum()))


def fingerprint(text: str) -> np.ndarray:
    return chunks(text.encode())[0]


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``after``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _ranges(docs: DataFrame, count: int) -> tuple[Column, int]:
    """The number of the range that a row of doc_id and text lies in, and how many there are: about ``count``, with as many rows each.

    An id with the rows of several ranges is cut by the place of its texts, and so are rows without an id.
    """
    ids = docs.select("doc_id")
    steps = [k / count for k in range(1, count)] or [0.5]
    found, rows, named = ids.agg(F.percentile_approx("doc_id", steps, max(10000, 10 * count)), F.count("*"), F.count("doc_id")).first()
    nameless = -(-count * (rows - named) // max(1, rows))
    bounds = sorted(Counter(found or []).items()) if count > 1 else []
    starts = list(accumulate((n for _, n in bounds), initial=nameless + 1))
    cut = lambda n: F.floor(F.col("place") * n / PLACES).cast("int")
    number = F.lit(nameless)
    if bounds:
        width = max(1, int(len(bounds) ** 0.5))
        groups = [[b for b, _ in bounds[k : k + width]] for k in range(0, len(bounds), width)]

        def below(among: Column) -> Column:
            return F.size(F.filter(among, lambda b: b <= F.col("doc_id")))

        coarse = below(F.array(*[F.lit(g[0]) for g in groups]))
        fine = below(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(coarse, F.lit(1))))
        at = F.greatest((coarse - 1) * width + fine, F.lit(0)) + 1  # 1: before all bounds
        last = F.element_at(F.array(*[F.lit(x - 1) for x in starts]), at)
        number = last
        if hot := {b: (start, n) for (b, n), start in zip(bounds, starts, strict=False) if n > 1}:
            entry = lambda k: F.element_at(F.create_map(*[F.lit(x) for b, v in hot.items() for x in (b, v[k])]), F.col("doc_id"))
            number = F.when(F.col("doc_id").isin(list(hot)), entry(0) + cut(entry(1))).otherwise(last)
    first = cut(F.lit(nameless)) if nameless else F.lit(0)
    return F.when(F.col("doc_id").isNull(), first).otherwise(number).cast("int"), starts[-1]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id (integer), text. Fingerprints each text, its edited text and compares it with both and the next one.

    Texts are shuffled once, by ranges of ids, a range for each task. The end of
    each range gets a copy of the first row of the next one, found by the ids.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(PLACES)))
    number, count = _ranges(docs, parts)
    docs = docs.withColumn("range", number)
    # A row for each range: the first id there, and the last range before it that has rows.
    heads = docs.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id"))["doc_id"].alias("head_id"))
    order = Window.orderBy("range")
    heads = heads.select("head_id", F.col("range").alias("head_range"), F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("into"))
    first = docs.join(F.broadcast(heads), (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    ghosts = first.groupBy("head_range", "into").agg(F.min(F.struct("place", "text"))["text"].alias("text"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("place"), F.col("into").alias("range"), F.lit(True).alias("ghost"))
    rows = docs.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartitionById(count, "range")
    rows = rows.sortWithinPartitions("range", "ghost", F.col("doc_id").asc_nulls_first(), "place", "text").select("doc_id", "text", "ghost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                columns: list[list] = [[] for _ in ARROW]
                for doc_id, text, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mark = fingerprint(text)
                    if held:
                        own_id, own, own_mark = held
                        other = edited(own, text)
                        other_mark = fingerprint(other)
                        row = own_id, len(own), hashlib.sha256(other.encode()).hexdigest(), encode(own_mark), encode(other_mark), containment(own_mark, other_mark), containment(own_mark, mark)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                    held = None if ghost else (doc_id, text, mark)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return rows.mapInArrow(tidy(run), SCHEMA)


def op4_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
