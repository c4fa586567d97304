"""Shared plumbing: shared-folder tables and bounded Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; a private one is set only
    where none is configured and the master is local, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        found = found.rpartition("/")[0] if found else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", group_bytes: int = 128 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    and a lost executor costs no recomputation of what stands before. Writer and
    reader hold a row group of about ``group_bytes`` each; less suits large
    binary values."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).option("parquet.block.size", group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(
    batches: Iterator[pa.RecordBatch], limit: int, key: str = "doc_id", text: str = "text"
) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null: empty) in slices of about ``limit`` characters;
    a longer text makes a slice of its own."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
            t = t.as_py() or ""
            if keys and size + len(t) > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t)
        if keys:
            yield keys, texts


def give_back() -> None:
    """Return what this Python worker no longer uses to the system: the worker
    lives on, and beside it the next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, giving memory back at the task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def sent(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of keys, to be broadcast if it has at most ``most`` rows;
    beyond that its join is a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def fan_out(spark: SparkSession) -> int:
    """Partitions of a hash shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
