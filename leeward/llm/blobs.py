"""Sorted hash lists as short byte strings, so that a shuffle moves a few bytes per hash and no row per hash.

A map task sorts the hashes of a piece of text, cuts them at the bounds of the hash ranges
("buckets") and sends one row per bucket. Values are differences to the one before, laid out by byte
plane: the high planes are zeros, which Spark's shuffle compression removes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(ordered: np.ndarray) -> bytes:
    """A sorted uint64 array."""
    return planes(np.diff(ordered, prepend=np.uint64(0)))


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


def bucket_count(docs: DataFrame, column: str, bytes_per_bucket: int) -> int:
    """How many buckets keep one bucket's hashes within memory, from the bytes of all texts (one scan, no shuffle)."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)).cast("double")).alias("n")).first()["n"] or 0.0
    return max(8, math.ceil(total / bytes_per_bucket))


def cut(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal values."""
    if len(buckets) == 0:
        return
    at = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(buckets[a]), a, b
