"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide, under the SHA-256
of the stored bytes, as a member of a tar file in a shared folder: once in all
shards, however many rows have it. The rows' payloads are named by digest first.
Those that only one row has are stored by the task that reads it; of the others
each task sends one copy to the task that stores all of that digest. Each task
writes shards of its own, under names that no other attempt uses; only members of
attempts that succeeded are listed.

There are two tables: rows carry the payload's digest; members carry it with the
stored bytes' digest, shard, offset and length. Metadata columns of members are
filled from their first 33 bytes; whole members are read only for features, once
each, and rows get them by digest.

Defined results: a null text is empty, and the payload of an empty text is one
row of zeros; a null id stays null; rows with equal payloads, repeated rows among
them, share a member and have equal values; rows need no order, so there are no
ties; an empty table gives no rows and no shard. Columns that the operator
doesn't use may have any name.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy
from .storage import fresh_path, materialise
from .tokens import slices

WIDTH = 64
PLACES = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if m := re.fullmatch(r"file:/*(/.*)", path):
        path = m[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    lines = np.concatenate((np.zeros((len(rows), 1), dtype=np.uint8), rows), axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != int.from_bytes(data[29:33], "big"):
        raise ValueError("not the start of a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = read_header(data)
    at, parts = HEADER_BYTES, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 16-bin histogram in tenths of a per cent."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    seen = share[share > 0]
    bins = np.rint(share.reshape(16, 16).sum(axis=1) * 1000).astype(int)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(seen * np.log2(seen)).sum():.4f};hist=" + ",".join(map(str, bins))


class ShardWriter:
    """Writes members into tar shards of about ``shard_bytes`` and tells where each one's bytes are."""

    def __init__(self, root: str, shard_bytes: int):
        self.root, self.shard_bytes = root, shard_bytes
        self.tar = self.sink = None

    def put(self, data: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(data).hexdigest()
        if self.tar is None:
            store, root = open_store(self.root)
            store.create_dir(root, recursive=True)
            self.shard = f"{self.root}/shard-{uuid.uuid4().hex}.tar"
            self.sink = store.open_output_stream(open_store(self.shard)[1])
            self.tar = tarfile.open(fileobj=self.sink, mode="w|", format=tarfile.USTAR_FORMAT)
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        place = digest, self.shard, self.tar.offset + tarfile.BLOCKSIZE, len(data)
        self.tar.addfile(info, io.BytesIO(data))
        if self.tar.offset >= self.shard_bytes:
            self.close()
        return place

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.sink.close()
            self.tar = None


MEMBER = "key binary, digest string, shard string, offset long, length long"
_KINDS = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())


def _key(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()


def _place(key: bytes) -> int:
    return int.from_bytes(key[:4], "big") % PLACES


def _members(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _KINDS, strict=True)], names=["key", "digest", "shard", "offset", "length"])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                key = _key(payload_of(text or ""))
                rows.append((len((text or "").encode()), key, _place(key)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = pa.int64(), pa.binary(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "key", "place"]
            )


def store_payloads(docs: DataFrame, root: str, shard_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (integer), text. Writes the shards; returns rows (doc_id, n_bytes, key) and members (key, digest, shard, offset, length).

    Both are tables of their own. Which digests several rows have is told to the
    tasks by a bit for each of 2**20 places, so that they keep other payloads.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select("doc_id", "text").mapInArrow(tidy(_name), "doc_id long, n_bytes long, key binary, place int"), "media-rows")
    repeated = rows.groupBy("key", "place").count().where("count > 1").select("place").distinct()
    bits = np.zeros(PLACES, dtype=bool)
    bits[[r[0] for r in repeated.collect()]] = True  # at most PLACES numbers
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def several(key: bytes) -> bool:
        place = _place(key)
        return bool(shared.value[place >> 3] >> (7 - (place & 7)) & 1)

    def store_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(root, shard_bytes)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = []
                for text in batch.column("text").to_pylist():
                    payload = payload_of(text or "")
                    if not several(key := _key(payload)):
                        found.append((key, *writer.put(to_png(payload))))
                yield _members(found)
        writer.close()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of the rows of one task
        for whole in batches:
            for batch in slices(whole, "text"):
                found: dict[bytes, bytes] = {}
                for text in batch.column("text").to_pylist():
                    payload = payload_of(text or "")
                    if several(key := _key(payload)) and key not in seen:
                        seen.add(key)
                        found[key] = payload
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary()), pa.array(found.values(), type=pa.binary())], names=["key", "payload"])

    def store_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, last = ShardWriter(root, shard_bytes), None
        for whole in batches:
            for batch in slices(whole, "payload"):
                found = []
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    if key != last:
                        found.append((key, *writer.put(to_png(payload))))
                    last = key
                yield _members(found)
        writer.close()

    texts = docs.select("text")
    single = materialise(texts.mapInArrow(tidy(store_single), MEMBER), "media-single")
    copies = texts.mapInArrow(tidy(pick), "key binary, payload binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several_rows = materialise(copies.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(store_sorted), MEMBER), "media-several")
    return rows.select("doc_id", "n_bytes", "key"), single.unionByName(several_rows)


class RangeReader:
    """Reads byte ranges and keeps the last few shards open."""

    def __init__(self):
        self.files: dict = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.files:
            if len(self.files) >= 8:
                self.files.pop(next(iter(self.files))).close()
            store, path = open_store(shard)
            self.files[shard] = store.open_input_file(path)
        return self.files[shard].read_at(length, offset)


def spread_index(index: DataFrame, piece_bytes: int = 8 << 20, most_pieces: int = 20_000) -> DataFrame:
    """Members dealt out by pieces of shards, so that tasks have about as many bytes to read, whatever the table's own files hold."""
    total = index.agg(F.sum("length")).first()[0] or 0
    size = max(piece_bytes, total // most_pieces)
    return index.repartition(1 + total // size, "shard", F.floor(F.col("offset") / size))


def fill_metadata(index: DataFrame) -> DataFrame:
    """Adds width, height and bits to members, reading the first bytes of each member only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            found = [read_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            columns = [pa.array([f[i] for f in found], type=pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])

    return index.mapInArrow(tidy(run), f"{_ddl(index)}, width long, height long, bits long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def read_features(index: DataFrame) -> DataFrame:
    """Adds what the whole stored members hold: payload sizes and digests, and features."""
    kinds = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            found = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                data = reader.read(*place)
                payload = from_png(data)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).hexdigest(), features_of(payload)))
            columns = [pa.array([f[i] for f in found], type=k) for i, (_, k) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in kinds)])

    return index.mapInArrow(tidy(run), f"{_ddl(index)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def op7_store_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as stored media, read back."""
    rows, members = store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "media"))
    found = rows.join(read_features(fill_metadata(spread_index(members))), "key")
    return found.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "length AS media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "width", "height", "bits",
    )
