"""Sorted keys and small numbers as byte strings, laid out so that the shuffle's compression takes their zeros."""

from __future__ import annotations

import numpy as np


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 values as the byte planes of their steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def pack(a: np.ndarray, kind: type) -> bytes:
    return _planes(np.ascontiguousarray(a, kind))


def unpack(data: bytes, kind: type) -> np.ndarray:
    return _unplanes(data, kind)
