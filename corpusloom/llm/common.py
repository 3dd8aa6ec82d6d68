"""Shared plumbing of the llm operators: table access, checkpoints, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests on one machine) a folder below the warehouse is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small or medium frame reliably and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``cut``, but as a Parquet table, which is smaller for wide rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of frames that are no longer referred to.

    It does so when the driver's JVM collects its garbage, which with little driver work may be
    long after; a job of many steps would keep the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents_of(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (string), whatever else the frame holds."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make()`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows whose text ``make()(texts)`` marks, with all their columns and without a shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(test(part.column(at).cast(pa.string()))))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, column: str | int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece but a single row's holds over ``most_bytes`` of text.

    Whole rows only: it bounds the memory of vectorised steps, never the text.
    """
    arr = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(arr), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, null as empty: (bytes, offsets[n+1])."""
    arr = pc.fill_null(arr, "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back, as a Python worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
