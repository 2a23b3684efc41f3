"""Vectors as whole numbers, and matrices as binary columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = [np.int16, np.int32, np.int64]


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; an empty vector is."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component), taken as double, as longs; what longs can't hold becomes the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(v * scale))


def matrix(rows, width: int) -> np.ndarray:
    """An Arrow column of lists of longs as a matrix; shorter rows end in zeros."""
    if hasattr(rows, "combine_chunks"):
        rows = rows.combine_chunks()
    sizes = np.asarray(rows.value_lengths(), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(rows.flatten(), np.int64)
    return out


def packed(x: np.ndarray) -> bytes:
    """A matrix of longs in the narrowest kind that holds it, its size in bytes before it."""
    top, low = (int(x.max()), int(x.min())) if x.size else (0, 0)
    kind = next(k for k in KINDS if np.iinfo(k).min <= low and top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    kind = {np.dtype(k).itemsize: k for k in KINDS}[data[0]]
    flat = np.frombuffer(data, kind, offset=1)
    return flat.reshape(-1, width) if width else np.zeros((0, 0), kind)
