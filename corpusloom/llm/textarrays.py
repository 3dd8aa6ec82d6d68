"""Texts as arrays of lower-cased code points, for vectorised features."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import char_classes
from .common import flat_bytes


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case by code point, where it is a single code point."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, and offsets by text."""
    data, offsets = flat_bytes(texts)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    return lower_table()[cps], np.searchsorted(begins, offsets)


def letters(cps: np.ndarray) -> np.ndarray:
    return char_classes()[cps] == 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: how rows are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def stratified(df: DataFrame, class_col: str, id_cols: tuple[str, ...], per_class: dict) -> DataFrame:
    """About as many rows of each class as ``per_class`` says, chosen by a hash of ``id_cols``; all rows of smaller classes.

    The class counts come from one aggregation; they are as many as the classes.
    """
    counts = {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}
    share = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, per_class[value] / n))).otherwise(share)
    u = (F.xxhash64(F.lit(20), *id_cols).cast("double") / F.lit(2.0**64)) + 0.5
    return df.where(u < share)
