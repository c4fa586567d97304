"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples to a row, in a tar
shard under the shared folder. Each content is stored once: texts that occur
once are written where they are read, the others meet by their hash first. Rows
carry the shard, digest, offset and length of their member and never the bytes.
Metadata columns are filled from range reads of a member's header alone;
features from a read of the whole member, done once for each.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fan_out, fresh_path, materialize

#: Samples in an image row, and what payloads are padded to a multiple of.
WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length, tag, thirteen bytes of IHDR and their checksum.
HEADER_BYTES = 33


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes closed by zeros up to a positive multiple of ``WIDTH``."""
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """A greyscale PNG whose samples are the payload; a pure function of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first ``HEADER_BYTES`` bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def decode_image(data: bytes) -> bytes:
    """The samples of an image made by ``encode_image``, with checksums checked."""
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, parts = HEADER_BYTES, []
    while at < len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(tag + body):
            raise ValueError("damaged chunk")
        if tag == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Mean, deviation, entropy and a 64-bit average hash of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(samples))
    spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(samples)))
    blocks = np.array([b.mean() for b in np.array_split(samples, 64)])
    bits = int.from_bytes(np.packbits(blocks > blocks.mean()).tobytes(), "big")
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};ahash={bits:016x}"


class ShardWriter:
    """Appends members to a tar shard, each content once, and rolls over to a
    new shard at ``limit`` bytes. Names are unique to the attempt: a task that
    is run again writes shards of its own, and only committed rows are read. On
    an error the shard at hand is removed."""

    def __init__(self, folder: str, limit: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.sink = limit, None

    def __enter__(self) -> ShardWriter:
        return self

    def __exit__(self, error, *_) -> None:
        if self.sink is not None:
            self.close()
            if error is not None:
                self.files.delete_file(f"{self.folder}/{self.name}")

    def _open(self) -> None:
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.files.create_dir(self.folder, recursive=True)
        self.sink = self.files.open_output_stream(f"{self.folder}/{self.name}")
        self.at, self.placed = 0, {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """(shard, offset, length) of the member with this content."""
        if self.sink is None:
            self._open()
        if digest not in self.placed:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.placed[digest] = (self.name, self.at + len(head), len(data))
            self.sink.write(head + data + bytes(-len(data) % 512))
            self.at += len(head) + len(data) + -len(data) % 512
        found = self.placed[digest]
        if self.at >= self.limit:
            self.close()
        return found

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(bytes(1024))
            self.sink.close()
            self.sink = None


_PLACE = "n_bytes long, digest string, shard string, offset long, length long"
_STORED = f"doc_id long, {_PLACE}"
#: Texts that occur more than once, by their hash, up to which the list of them
#: is sent to all tasks; above it rows and list meet in a shuffle.
SENT = 2_000_000


def _write(folder: str, shard_bytes: int, key: str):
    """Texts to members: ``key``, what ``_PLACE`` says, and the texts of rows
    marked ``again``, which are not written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ShardWriter(folder, shard_bytes) as writer:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part, rows = batch.slice(at, 256), []
                    for text, again in zip(part.column("text"), part.column("again").to_pylist(), strict=True):
                        text = text.as_py()
                        if again:
                            rows.append((len(text.encode()), None, None, None, None, text))
                            continue
                        image = encode_image(payload_of(text))
                        digest = hashlib.sha256(image).hexdigest()
                        rows.append((len(text.encode()), digest, *writer.add(digest, image), None))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, "n_bytes", "digest", "shard", "offset", "length", "text"])

    return run


def store(docs: DataFrame, folder: str, shard_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Write every distinct text's payload into shards, once.

    Returns (members, rows): a row for each member with ``doc_id`` if its text
    occurs once, else with ``key``, the text's SHA-256; and (doc_id, key) of all
    rows whose text occurs more than once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    marks = texts.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark", F.lit(True).alias("again"))
    marks = materialize(marks, "repeated")
    marks = F.broadcast(marks) if marks.count() <= SENT else marks
    seen = texts.join(marks, "mark", "left").select("doc_id", "text", F.coalesce("again", F.lit(False)).alias("again"))
    # Written at once: reading these rows twice must not write the shards twice.
    once = materialize(seen.mapInArrow(_write(folder, shard_bytes, "doc_id"), f"{_STORED}, text string"), "members")
    rest = once.where("shard is null").select("doc_id", "text", F.sha2("text", 256).alias("key"))
    # A task's copies are dropped before the shuffle, so a hot text is no hot key.
    distinct = rest.groupBy("key").agg(F.first("text").alias("text")).withColumn("again", F.lit(False))
    shared = materialize(distinct.mapInArrow(_write(folder, shard_bytes, "key"), f"key string, {_PLACE}, text string"), "members")
    own = once.where("shard is not null").drop("text").withColumn("key", F.lit(None).cast("string"))
    members = own.unionByName(shared.drop("text").withColumn("doc_id", F.lit(None).cast("long")))
    # Dealt by place, so that tasks grow with the bytes and read shards in order.
    size = members.agg(F.sum("length")).first()[0] or 0
    return members.repartitionByRange(max(fan_out(spark), size // (16 << 20)), "shard", "offset").sortWithinPartitions("shard", "offset"), rest.select("doc_id", "key")


def _over_members(members: DataFrame, folder: str, work, schema: str, whole: bool) -> DataFrame:
    """``members`` with ``work(bytes of a member)``; ``whole`` reads all of a
    member, else its header only."""
    kinds = [f.split() for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, handle = None, None
        try:
            for batch in batches:
                found = []
                for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if shard != name:
                        if handle:
                            handle.close()
                        name, handle = shard, files.open_input_file(f"{root}/{shard}")
                    found.append(work(handle.read_at(length if whole else min(length, HEADER_BYTES), offset)))
                added = [pa.array([f[i] for f in found], arrow[kind]) for i, (_, kind) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(k for k, _ in kinds)])
        finally:
            if handle:
                handle.close()

    have = ", ".join(f"{n} {k}" for n, k in members.dtypes)
    return members.mapInArrow(run, f"{have}, {schema}")


def with_metadata(members: DataFrame, folder: str) -> DataFrame:
    """Members with width, height and depth, from header reads alone."""
    return _over_members(members, folder, read_header, "width long, height long, depth long", False)


def with_features(members: DataFrame, folder: str) -> DataFrame:
    """Members with what a read of the whole member tells."""

    def work(data: bytes) -> tuple:
        payload = decode_image(data)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features_of(payload),
        )

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _over_members(members, folder, work, schema, True)


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Store all texts and read them back: one row for each row of ``docs``, with
    digest, shard, offset and length of its member.

    A null text is the empty one, which is a payload of 64 zeros. Equal texts
    have equal values in every column; repeated rows and null ids return rows of
    their own. An empty table writes no shard and returns no rows; other columns
    are ignored.
    """
    folder = folder or fresh_path(docs.sparkSession, "media")
    members, repeated = store(docs, folder, shard_bytes)
    filled = materialize(with_features(with_metadata(members, folder), folder), "features")
    own = filled.where("key is null").drop("key")
    shared = repeated.join(filled.where("key is not null").drop("doc_id"), "key").drop("key")
    return own.unionByName(shared)
