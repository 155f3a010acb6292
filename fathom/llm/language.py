"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed character n-grams says how much a text looks like the languages whose bit
is 1; it is a pair of smoothed n-gram models. Decoding takes the language whose
codeword has the least loss, each bit's loss being weighed by how well the bit's
classifier told its two sides apart in training.

N-grams are of 1 to 4 letters, within words set between blanks, in lower case; what
is no letter parts words and is never a feature, so digits, marks and markup
don't matter.

Defined results: ``und`` with score 0 for a null text and one without a letter;
rows with a null language or a null id aren't learned; repeated rows are predicted
alike; ties go to the language that sorts first; without any labelled row
everything is ``und``; an empty table gives no rows. Columns that the operator
doesn't use may have any name; those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import tidy

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 15
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_letters: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point of the basic plane: itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint32)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, 0 for what is no letter; later planes count as letters if Python says so."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(points) and points.max() > 0xFFFF:
        high = points > 0xFFFF
        out = _fold()[np.where(high, 0, points)]
        out[high] = [c if chr(c).isalpha() else 0 for c in points[high].tolist()]
        return out
    return _fold()[points]


def features(points: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams; the last place counts the letters."""
    p = np.concatenate(([0], points, [0])).astype(np.uint32)
    p = p[np.concatenate(([True], (p[1:] != 0) | (p[:-1] != 0)))]  # one blank between words
    counts = np.zeros(DIMENSIONS, dtype=np.float32)
    h = p * _MIX[0]
    word = p != 0
    inner = word.copy()  # a blank may open or close an n-gram, not stand inside
    hashes = [h[word]]
    for n in ORDERS[1:]:
        if len(p) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[n - 1] + p[n - 1 :]
        inner = np.ones(len(h), dtype=bool) if n == 2 else inner[: len(h)] & word[n - 2 : n - 2 + len(h)]
        keep = inner if n > 2 else word[: len(h)] | word[1 : 1 + len(h)]
        hashes.append(h[keep] + np.uint32(n))
    every = np.concatenate(hashes)
    every = (every ^ (every >> np.uint32(16))) * _MIX[1]
    counts += np.bincount(every >> np.uint32(17), minlength=DIMENSIONS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1. All splits for up to 7 languages; else the best of some random codes."""
    if languages <= 7:
        bits = max(1, 2 ** (languages - 1) - 1)
        return np.array([[1 if i == 0 or not (k + 1) >> (i - 1) & 1 else -1 for k in range(bits)] for i in range(max(1, languages))], dtype=np.float32)
    rng, best, apart = np.random.default_rng(7), None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), size=(languages, 15 + 4 * languages.bit_length()))
        gap = ((code.shape[1] - code @ code.T) / 2 + np.eye(languages) * 1e9).min()
        if gap > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits: log odds of an n-gram
    scale: np.ndarray  # bits: what a mean log odds is divided by
    trust: np.ndarray  # bits: weight of the bit's loss

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the two nearest codewords are about as near."""
        points = code_points(text) if text else np.zeros(0, dtype=np.uint32)
        if not points.any() or not self.languages:
            return UNKNOWN, 0.0, True
        counts = features(points)
        at = np.flatnonzero(counts)
        seen = counts[at]
        margins = (seen @ self.weights[at]) / seen.sum() / self.scale
        certainty = min(1.0, np.sqrt(seen.sum() / 200.0))
        loss = (np.log1p(np.exp(-3.0 * self.codes * margins)) * self.trust).sum(axis=1) / self.trust.sum()
        chance = np.exp(-8.0 * certainty * (loss - loss.min()))
        chance /= chance.sum()
        best = int(np.argmax(chance))
        rest = np.delete(chance, best)
        return self.languages[best], float(chance[best]), bool(len(rest) and chance[best] < 2 * rest.max())


def _sums(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their n-gram sums; a language's rows (of a bounded sample) meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + features(code_points(text or "")).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), pa.array([s.tobytes() for s in sums.values()], type=pa.binary())], names=["lang", "sums"])

    total = {lang: np.frombuffer(bytes(data), dtype=np.float64) for lang, data in rows.repartition(32, "lang").mapInArrow(tidy(run), "lang string, sums binary").toLocalIterator()}
    names = sorted(total)
    return names, np.array([total[x] for x in names]).reshape(len(names), DIMENSIONS)


def train(docs: DataFrame, most_rows: int = 1000, most_languages: int = 256) -> Model:
    """docs: doc_id, text, lang. Learns from the ``most_rows`` rows of each language whose ids hash lowest.

    That bound and ``most_languages`` (the most frequent ones, the limit of what a
    model tells apart; others are never predicted) bound the sample; of each
    language only its n-gram sums reach the driver, each once.
    """
    docs = docs.select("doc_id", "text", "lang")
    labelled = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang")
    often = [tuple(r) for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    if not often:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.ones(1), np.ones(1))
    # About twice as many as are wanted, by a bound on the hash, before any language's rows meet in a task.
    sieve = F.create_map(*[F.lit(x) for lang, n in often for x in (lang, min(1.0, (2.0 * most_rows + 100) / n))])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("share"), "doc_id"))
    sample = labelled.withColumn("share", share).where(F.col("share") < F.element_at(sieve, F.col("lang")))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= most_rows)
    picked = sample.groupBy(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang")).count().drop("count")
    rows = docs.join(F.broadcast(picked), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang"))).select("text", "lang")
    languages, sums = _sums(rows)
    codes = codewords(len(languages))
    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1)
    weights = np.zeros((DIMENSIONS, codes.shape[1]), dtype=np.float32)
    flat = 0.5 / DIMENSIONS
    for bit in range(codes.shape[1]):
        yes, no = (share[codes[:, bit] == side].mean(axis=0) if (codes[:, bit] == side).any() else np.full(DIMENSIONS, 1 / DIMENSIONS) for side in (1, -1))
        weights[:, bit] = np.log((yes + flat) / (no + flat))
    means = share @ weights  # languages x bits: what a language's own n-grams score on average
    right = means * codes
    scale = np.maximum(np.abs(means).mean(axis=0), 1e-6)
    trust = np.clip((right / scale).min(axis=0), 0.05, None)
    return Model(languages, codes, weights, scale.astype(np.float32), trust.astype(np.float32))


SCHEMA = "lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs: text and any other columns. Adds lang_pred, score and ambiguous. The model's size doesn't depend on the data."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = ("lang_pred", "score", "ambiguous")
    fields = [f for f in docs.schema if f.name.lower() not in results]
    # Names of our own on the way, as those of docs may be such that Arrow functions don't take.
    plain = docs.select(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(fields)))
    text = next(k for k, f in enumerate(fields) if f.name == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([f[i] for f in found], type=kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *results])

    kept = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields))
    return plain.mapInArrow(tidy(run), f"{kept}, {SCHEMA}").toDF(*(f.name for f in fields), *results)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
