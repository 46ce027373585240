"""Texts cut into hashed tokens with array operations, a slice of texts at a time.

A text longer than ``PIECE`` is worked on in pieces, with what the next piece
needs carried over, so the result is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from .common import small_slices, text_bytes

PIECE = 500_000  # bytes of text worked on at a time
ODD = 0xD6E8FEB86659FD93

Piece = tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]
Block = tuple[np.ndarray, np.ndarray, int]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Iterator[Piece]]]:
    """(slice of rows, its pieces): each piece is (row of each text, bytes, offsets, guards).

    A text over ``limit`` bytes comes in several pieces. Each has the character
    before and the one behind it as well, where there are such; ``guards`` says how
    many of these it has at the front and at the back (0 or 1).
    """
    for batch in small_slices(batches, column, limit):
        raw, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        if len(raw) <= limit:
            yield batch, iter([(np.arange(batch.num_rows), raw, off, (0, 0))])
        else:
            yield batch, _cut(raw, off, limit)


def _cut(raw: np.ndarray, off: np.ndarray, limit: int) -> Iterator[Piece]:
    def back(at: int) -> int:
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    for row in range(len(off) - 1):
        first, end = int(off[row]), int(off[row + 1])
        at = first
        while at < end:
            to = at + limit
            to = max(back(to), at + 1) if to < end else end
            while to < end and raw[to] & 0xC0 == 0x80:
                to += 1
            front, behind = (back(at - 1) if at > first else at), to
            if to < end:
                behind += 1
                while behind < end and raw[behind] & 0xC0 == 0x80:
                    behind += 1
            yield np.array([row]), raw[front:behind], np.array([0, behind - front]), (int(front < at), int(behind > to))
            at = to


def token_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Iterator[Block]]]:
    """(slice of rows, its blocks): each block is (row of each token, hash of each token, seen).

    A text over ``limit`` bytes comes in several blocks of whole tokens, however
    long a token is. Each begins with the last two tokens of the one before it;
    ``seen`` says how many of a block's tokens were given before.
    """
    for batch in small_slices(batches, column, limit):
        raw, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        if len(raw) <= limit:
            yield batch, iter([(*tokens(raw, off), 0)])
        else:
            yield batch, _long_blocks(raw, off, limit)


def _long_blocks(raw: np.ndarray, off: np.ndarray, limit: int) -> Iterator[Block]:
    for row in range(len(off) - 1):
        last = np.zeros(0, np.uint64)  # the two tokens before
        open_ = None  # (kind, unfinished hash) of the token that may go on
        first, end = int(off[row]), int(off[row + 1])
        for at in range(first, end, limit):
            part = raw[at : min(at + limit, end)]
            begin, stop, kind = _spans(part, np.array([0, len(part)]))
            h = _unfinished(part, begin, stop)
            if open_ is not None:
                if open_[0] == kind[0]:
                    with np.errstate(over="ignore"):
                        h[0] += open_[1] * np.uint64(pow(ODD, int(stop[0]), 1 << 64))
                else:
                    kind, h = np.append(open_[0], kind), np.append(open_[1], h)
            if at + limit < end:
                open_ = (kind[-1], h[-1])
                kind, h = kind[:-1], h[:-1]
            found = _finished(h[kind != 0])
            if len(found):
                block = np.concatenate([last, found])
                yield np.full(len(block), row), block, len(last)
                last = block[-2:]


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=9) for b in range(256)], np.uint64)
    return table, np.cumprod(np.full(size, ODD, np.uint64)), np.cumprod(np.full(size, pow(ODD, -1, 1 << 64), np.uint64))


@cache
def _classes() -> np.ndarray:
    """0 white space and controls, 1 letters (with all bytes over 127), 2 digits, 3 the rest."""
    kind = np.full(256, 3, np.uint8)
    kind[:33] = 0
    kind[127] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    return kind


def _spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, class) of all runs of one class within a text."""
    kind = _classes()[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[off[:-1][off[:-1] < len(raw)]] = True
    begin = np.flatnonzero(fresh)
    return begin, np.append(begin[1:], len(raw)), kind[begin]


def _unfinished(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomials in ODD of the spans' bytes: that of a and b together is that of a times ODD**len(b), plus that of b."""
    table, up, down = _powers(1 << max(20, (len(raw) - 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * down[: len(raw)])])
        return (total[end] - total[begin]) * up[end - 1]


def _finished(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ h >> np.uint64(29)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each token, hash of each token), in order. Tokens are runs of letters, digits or signs."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin, end, kind = _spans(raw, off)
    begin, end = begin[kind != 0], end[kind != 0]
    return np.searchsorted(off, begin, side="right") - 1, _finished(_unfinished(raw, begin, end))
