"""Keeps Python workers small: what they free goes back to the system.

Workers outlive their tasks, and several of one executor are alive at once. By default glibc raises
the size from which a block is given back when freed, and Arrow pools what it frees; both would
leave every worker as large as its largest moment.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

_TRIM, _MMAP = -1, -3  # of mallopt(3)


def keep_small(block: int = 6 << 20) -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # another C library has none and needs none
    if mallopt is not None:
        mallopt(_MMAP, block)
        mallopt(_TRIM, 2 * block)


keep_small()
