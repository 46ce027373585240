"""Hashed word shingles of a text, and its fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

MAX_BITS = 4  # fingerprints that differ in no more are near
BLOCK = 200_000  # shingles hashed at a time


def shingles(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``words`` words (of the whole text, if it has fewer), block by block."""
    found = text.lower().split()  # bytes: A-Z only, and the white space named in WORD_PATTERN
    if not found:
        return
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    starts, ends = starts[: len(found) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        yield np.array([digest(flat[s:e], 42) for s, e in zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint; a bit is set if over half of the shingle hashes have it."""
    n, total = 0, np.zeros(64, np.int64)
    for hashes in shingles(text, words):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])
