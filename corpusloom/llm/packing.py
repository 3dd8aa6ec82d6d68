"""Sequence packing by power-of-two decomposition.

A document's ids and one end id are cut into pieces whose lengths are powers of
two, largest first and at most ``max_len``.  Each piece is a sequence of its own,
so no sequence crosses documents, and as its length is a power of two it needs no
padding.  Equal lengths share a bucket, from which batches of one shape are read.

Defined cases: null or empty text has the end id alone, one piece of length 1;
repeated rows give repeated pieces under different sequence ids; texts of any
length are cut whole; a null doc_id is kept; an empty table gives no rows; other
columns, whatever their names, are ignored.  A sequence id holds the task's
partition above the place in it, so it is unique without a shuffle, and a task
that runs again for a lost executor gives the same ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder
from .common import documents_of, flat_bytes, map_batches, slices


def binary_pieces(n: int, max_len: int = 2048) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole ``max_len`` first, then the bits of the rest, high to low."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, *, max_len: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket [, ids]."""

    def make():
        encoder = Encoder(path)
        base = TaskContext.get().partitionId() << 33
        made = 0

        def step(batch: pa.RecordBatch):
            nonlocal made
            for part in slices(batch, "text"):
                ids, offsets = encoder(*flat_bytes(part.column("text")))
                n = part.num_rows
                ends = offsets[1:] + np.arange(1, n + 1)
                flat = np.full(len(ids) + n, end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                raw = memoryview(flat.astype("<u4").tobytes())
                sizes = [binary_pieces(k, max_len) for k in (np.diff(offsets) + 1).tolist()]
                counts = np.array([len(s) for s in sizes])
                length = np.array([x for s in sizes for x in s], np.int64)
                to = np.cumsum(length)
                at = to - length
                of = np.repeat(np.arange(n), counts)
                begin = ends - np.diff(offsets) - 1
                cols = {
                    "doc_id": part.column(0).take(pa.array(of)),
                    "start": pa.array(at - begin[of]),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), to.tolist())], pa.int64()),
                    "doc_tokens": pa.array((np.diff(offsets) + 1)[of]),
                    "sequence_id": pa.array(base + made + np.arange(len(length))),
                    "offset": pa.array(np.zeros(len(length), np.int64)),
                    "bucket": pa.array(np.log2(length).astype(np.int32)),
                }
                made += len(length)
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, to[-1]).astype(np.int32)), pa.array(flat))
                yield pa.record_batch(list(cols.values()), names=list(cols))

        return step

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    return map_batches(documents_of(docs), make, schema + ", ids array<int>" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces so that each length has a folder of its own."""
    pieces.write.partitionBy("bucket").parquet(path)
