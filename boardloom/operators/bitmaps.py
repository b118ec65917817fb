"""Compressed bitmaps over integer keys: per 65,536 keys a sorted array of 16-bit values, or a bit set where it is smaller."""

from __future__ import annotations

import numpy as np

ARRAY_MOST = 4096
Bitmap = dict[int, np.ndarray]


def pack(ids: np.ndarray) -> Bitmap:
    """The bitmap of a set of non-negative integers, given in any order, repeats allowed."""
    ids = np.unique(np.asarray(ids, dtype=np.int64))
    high = ids >> 16
    cuts = np.flatnonzero(np.diff(high)) + 1
    out: Bitmap = {}
    for part in np.split(ids, cuts):
        if len(part):
            low = (part & 0xFFFF).astype(np.uint16)
            out[int(part[0] >> 16)] = low if len(low) <= ARRAY_MOST else _dense(low)
    return out


def _dense(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(65_536, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _is_dense(c: np.ndarray) -> bool:
    return c.dtype == np.uint8


def and_not(a: Bitmap, b: Bitmap) -> Bitmap:
    """The keys of a that b lacks."""
    out: Bitmap = {}
    for k, x in a.items():
        y = b.get(k)
        if y is None:
            out[k] = x
        elif _is_dense(x):
            out[k] = x & ~(y if _is_dense(y) else _dense(y))
        elif _is_dense(y):
            out[k] = x[((y[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1) == 0]
        else:
            out[k] = np.setdiff1d(x, y, assume_unique=True)
    return out


def unpack(a: Bitmap) -> np.ndarray:
    """The keys in ascending order."""
    parts = [(np.flatnonzero(np.unpackbits(c)) if _is_dense(c) else c.astype(np.int64)) + (k << 16) for k, c in sorted(a.items())]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
