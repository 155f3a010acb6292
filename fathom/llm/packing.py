"""Hierarchical packing of documents into context windows of several lengths.

Whole windows of the longest tier are cut off a long document first; what is left
goes to the shortest tier that holds it. The longest piece of a pool opens a window
of its tier; the gap is filled with pieces of this tier and shorter ones: with one
or two that fill it exactly if there are such, else with the longest that fits, and
what then remains with the head of a longer piece. Windows so end full, at a power
of two, except for gaps of ``slack`` tokens at most in the longest tier.

Each task packs the documents of its own partition, so texts aren't shuffled. What
a partition can't pack well (``keep_tokens`` at most) is packed with that of other
partitions, 64 at a time, in as many rounds as it takes to one task; what that one
leaves is cut into full windows of falling powers of two.

Then windows are dealt to step groups of ``step_tokens`` tokens, over all
partitions: in the order of their attention costs (sums of squared piece lengths),
to and fro over the groups of their tier, so that the groups' costs are alike.
Ranks are counted in two steps, over cells of about equal costs and within them.

Defined results: a null or empty text has the end-of-document id alone; a null
id stays null; repeated rows are packed as documents of their own; of pieces of
equal length the one that came first is the shorter one; windows of about equal
cost are dealt by a hash of their number; an empty table gives no pieces. A
partition that is computed anew from the same rows gives the same pieces. Columns
that the operator doesn't use may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .memory import tidy
from .storage import materialise

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65536
MOST_CUTS = 3  # of a piece, if there are others
FAN_IN = 64  # partitions whose rests are packed together
LEVELS, SALTS = 256, 64

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window int, cost long, ids binary, part int, number long"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("window", pa.int32()), ("cost", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("number", pa.int64()),
])


class Packer:
    """Packs the pieces of a pool. A piece is (length, number, document, start, ids, cuts); they lie in the order of their lengths."""

    def __init__(self, tiers: Sequence[int], slack: int):
        self.tiers, self.slack = sorted(tiers), slack
        self.pool: list[tuple] = []
        self.lengths: list[int] = []
        self.windows: list[tuple[int, list[tuple]]] = []
        self.number = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, longest = len(ids), self.tiers[-1]
        full = n - n % longest
        for at in range(0, full, longest):
            self.windows.append((longest, [(longest, 0, (doc_id, n), at, ids[at : at + longest], 0)]))
        if n > full:
            self.put((doc_id, n), full, ids[full:].copy())

    def put(self, doc: tuple, start: int, ids: np.ndarray, cuts: int = 0) -> None:
        self.number += 1
        self._back((len(ids), self.number, doc, start, ids, cuts))

    def _back(self, piece: tuple) -> None:
        at = bisect_right(self.lengths, piece[0])
        self.lengths.insert(at, piece[0])
        self.pool.insert(at, piece)
        self.tokens += piece[0]

    def _take(self, at: int) -> tuple:
        self.tokens -= self.lengths.pop(at)
        return self.pool.pop(at)

    def _pair(self, gap: int) -> tuple[int, int] | None:
        """Two pieces that fill the gap, as much alike as there are; the longer one first."""
        lengths = self.lengths
        i = bisect_right(lengths, gap // 2) - 1
        while i >= 0:
            a = lengths[i]
            j = bisect_left(lengths, gap - a, i + 1)
            if j < len(lengths) and lengths[j] == gap - a:
                return j, i
            i = bisect_left(lengths, a, 0, i) - 1
        return None

    def _head(self, size: int) -> tuple:
        """Cuts ``size`` ids off a longer piece: the shortest that isn't cut up yet."""
        first = bisect_right(self.lengths, size)
        at = next((k for k in range(first, min(first + 64, len(self.pool))) if self.pool[k][5] < MOST_CUTS), first)
        _, number, doc, start, ids, cuts = self._take(at)
        self.put(doc, start + size, ids[size:], cuts + 1)
        return size, number, doc, start, ids[:size], cuts + 1

    def _fill(self, window: int) -> list[tuple]:
        """Pieces that fill a window, the longest that fits first, whole ones if some do; fewer tokens if the pool ends."""
        gap = window
        pieces = []
        while gap and self.pool:
            at = bisect_right(self.lengths, gap) - 1
            if at >= 0 and pieces and self.lengths[at] < gap and (both := self._pair(gap)):
                pieces += map(self._take, both)
                return pieces
            if at >= 0:
                pieces.append(self._take(at))
                gap -= pieces[-1][0]
            elif window == self.tiers[-1] and gap <= self.slack:
                break
            else:
                pieces.append(self._head(gap))
                gap = 0
        return pieces

    def pack(self, keep: int) -> None:
        """Packs the pool until it has at most ``keep`` tokens or too few for a window."""
        while self.tokens > keep:
            window = next(t for t in self.tiers if t >= self.lengths[-1])
            if self.tokens < window:
                break
            self.windows.append((window, self._fill(window)))

    def finish(self) -> None:
        """Packs what is left into full windows of falling powers of two."""
        while self.pool:
            window = min(self.tiers[-1], 1 << self.tokens.bit_length() - 1)
            self.windows.append((window, self._fill(window)))


class _Task:
    """One task's packer and what it tells."""

    def __init__(self, stage: int, tiers: Sequence[int], slack: int):
        from pyspark import TaskContext

        self.part = TaskContext.get().partitionId()
        self.sequence = stage << 58 | self.part << 32
        self.packer = Packer(tiers, slack)

    def emit(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The windows so far and, at the end, the pieces that are in none: they have no sequence."""
        columns: list[list] = [[] for _ in ARROW]

        def add(*row) -> None:
            for column, value in zip(columns, row, strict=True):
                column.append(value)

        for window, pieces in self.packer.windows:
            offset, cost = 0, sum(p[0] * p[0] for p in pieces)
            for length, number, (doc_id, n), start, ids, _ in pieces:
                add(doc_id, start, length, n, self.sequence, offset, window, cost, ids.tobytes(), self.part, number)
                offset += length
            self.sequence += 1
        self.packer.windows.clear()
        if last:
            for length, number, (doc_id, n), start, ids, _ in self.packer.pool:
                add(doc_id, start, length, n, None, None, None, None, ids.tobytes(), self.part, number)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _pack_texts(docs: DataFrame, path: str, tiers: Sequence[int], eos: int, slack: int, pool_tokens: int, keep_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        task = _Task(0, tiers, slack)
        held = 0
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                ids, starts = coder.encode(batch.column("text"), eos)
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    task.packer.add(doc_id, ids[starts[k] : starts[k + 1]])
                    held += starts[k + 1] - starts[k]
                    if held >= pool_tokens:
                        task.packer.pack(keep_tokens)
                        yield from task.emit()
                        held = task.packer.tokens
        task.packer.pack(keep_tokens)
        yield from task.emit(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def _pack_rests(rests: DataFrame, stage: int, parts: int, tiers: Sequence[int], slack: int, keep_tokens: int) -> DataFrame:
    """rests: pieces without a sequence, of partitions below ``parts``."""
    tasks = -(-parts // FAN_IN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(stage, tiers, slack)
        for batch in batches:
            for doc_id, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                task.packer.put((doc_id, n), start, np.frombuffer(ids, dtype="<u4"))
        task.packer.pack(0 if tasks == 1 else keep_tokens)
        if tasks == 1:
            task.packer.finish()
        yield from task.emit(True)

    dealt = rests.repartitionById(tasks, F.floor(F.col("part") / FAN_IN).cast("int")).sortWithinPartitions("part", "number")
    return dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(tidy(run), SCHEMA)


def pack(
    docs: DataFrame,
    tiers: Sequence[int] = TIERS,
    eos: int = 2,
    tokenizer: str | None = None,
    slack: int = 8,
    pool_tokens: int = 1 << 21,
    keep_tokens: int = 1 << 16,
) -> DataFrame:
    """docs: doc_id (integer), text. Returns the pieces, with their ids as little-endian 32-bit numbers and their window's attention cost.

    tiers: window lengths, powers of two. tokenizer: a file for the tokenizers
    library. pool_tokens: how much a task packs at a time, which bounds its
    memory. The pieces are tables of their own.
    """
    table = materialise(_pack_texts(docs, tokenizer or tokens.default_path(), tiers, eos, slack, pool_tokens, keep_tokens), "pieces")
    packed = table.where("sequence_id IS NOT NULL")
    stage = 0
    while True:
        rests = table.where("sequence_id IS NULL")
        last = rests.agg(F.max("part")).first()[0]
        if last is None:
            return packed.drop("part", "number")
        stage += 1
        table = materialise(_pack_rests(rests, stage, last + 1, tiers, slack, keep_tokens), "pieces")
        packed = packed.unionByName(table.where("sequence_id IS NOT NULL"))


def balance_steps(pieces: DataFrame, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """pieces: sequence_id, offset, window, cost. Returns sequence_id and step_id for each window.

    A step has windows of one tier; the few that are shorter than the least tier go with that one.
    """
    w = pieces.where("offset = 0").select("sequence_id", F.greatest("window", F.lit(min(tiers))).cast("long").alias("tier"), "cost")
    level = F.floor(F.lit(float(LEVELS)) * F.col("cost") / (F.col("tier") * F.col("tier"))).cast("int")
    w = w.select("sequence_id", "tier", (-level).alias("level"), F.pmod(F.xxhash64("sequence_id"), F.lit(SALTS)).alias("salt"))
    cells = w.groupBy("tier", "level", "salt").agg(F.count("*").alias("n"))
    # At most LEVELS + 1 levels a tier, and SALTS cells a level.
    levels = cells.groupBy("tier", "level").agg(F.sum("n").alias("l_n"))
    before = lambda group, order: Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("l_first", F.coalesce(F.sum("l_n").over(before(["tier"], "level")), F.lit(0)))
    every = levels.groupBy("tier").agg(F.sum("l_n").alias("all"))  # a row for each tier
    every = every.withColumn("groups", F.ceil(F.col("all") * F.col("tier") / F.lit(step_tokens)).cast("long"))
    earlier = Window.orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)
    steps = every.select("tier", "groups", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("first_step"))
    levels = levels.join(F.broadcast(steps), "tier").select("tier", "level", "l_first", "groups", "first_step")
    cells = cells.withColumn("in_level", F.coalesce(F.sum("n").over(before(["tier", "level"], "salt")), F.lit(0)))
    cells = cells.join(F.broadcast(levels), ["tier", "level"]).withColumn("first", F.col("l_first") + F.col("in_level")).drop("n", "in_level", "l_first")
    within = Window.partitionBy("tier", "level", "salt").orderBy("sequence_id")
    ranked = w.join(cells, ["tier", "level", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    row, at = F.floor(F.col("rank") / F.col("groups")), F.col("rank") % F.col("groups")
    return ranked.select("sequence_id", (F.col("first_step") + F.when(row % 2 == 0, at).otherwise(F.col("groups") - 1 - at)).cast("long").alias("step_id"))


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with a checksum of their ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window")
    return found.join(balance_steps(pieces), "sequence_id")
