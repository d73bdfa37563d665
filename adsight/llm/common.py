"""Shared pieces of the text operators: words, held-out folds and packed number blobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[\\x20\\x09-\\x0D]+"


def words(text: Column | str) -> Column:
    """Lower-cased (A-Z only) words of a text, split at ASCII blanks; null gives an empty array.

    ``bytes.lower().split()`` is the same rule in Python.
    """
    column = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), BLANKS)
    return F.filter(parts, lambda w: w != "")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


def row_key(id_col: str, text_col: str) -> Column:
    """128-bit key of a row by id and text, told apart from nulls; equal rows share it."""
    known = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(
        known(F.col(id_col).cast("string")), F.lit("\u0000"), known(F.col(text_col)))))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as differences, one byte plane after the other.

    The upper planes are mostly zero, which the codec of shuffles and files removes.
    """
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """Inverse of :func:`pack_sorted`."""
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Unsigned counts as 64-bit byte planes."""
    return np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    """Inverse of :func:`pack_counts`."""
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
