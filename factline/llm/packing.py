"""Arrays as bytes that compress well in a shuffle."""

from __future__ import annotations

import numpy as np


def pack_hashes(h: np.ndarray) -> bytes:
    """Differences, byte by byte of equal weight: ascending hashes leave the first bytes zero for the shuffle's compression."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=np.uint64)
