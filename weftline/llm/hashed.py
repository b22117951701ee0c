"""Hashed byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time.
BLOCK = 1 << 20


def buckets(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams, in blocks; texts of one or two bytes have none."""
    for at in range(0, max(0, len(data) - 2), BLOCK):
        b = np.frombuffer(data[at : at + BLOCK + 2], np.uint8).astype(np.uint32)
        key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        yield (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def counts(data: bytes, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for block in buckets(data, bits):
        out += np.bincount(block, minlength=len(out))
    return out
