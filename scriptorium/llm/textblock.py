"""Byte-level, vectorised view of a batch of texts for the Arrow operators.

A block joins the UTF-8 texts with newlines, so every text starts and ends at
a separator. Word spans, rolling hashes and segment sums are then numpy
operations over the whole block; memory is bounded by the block's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}

#: Texts of at most this many bytes are worked on at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is not a letter; bytes of longer characters count as letters.
NON_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
NON_ALNUM = NON_LETTER.copy()
NON_ALNUM[48:58] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 8 * BLOCK_BYTES:
        _powers.clear()
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


class Block:
    """texts: list of bytes. data has a newline before, between and after them."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        if fold:
            self.data = LOWER[self.data]
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if self.n else np.zeros(0, np.int64)
        self.end = self.start + sizes

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of the runs of bytes that are no separators; newlines must be separators."""
        inside = ~separators[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        return edge[::2], edge[1::2]

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """Index of the first span of each text, and the number of spans at the end."""
        return np.append(np.searchsorted(starts, self.start), len(starts)) if self.n else np.zeros(1, np.int64)

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        up, self._down = _power(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes in every process."""
        return mix((prefix[end] - prefix[start]) * self._down[start])


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after another, and the offset of each."""
    size = end - start
    offset = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - offset[:-1], size) + np.arange(offset[-1])], offset


def encoded(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def lowered(text: bytes) -> bytes:
    """Lower case, one character for each character. ASCII is left to Block(fold=True)."""
    if text.isascii():
        return text
    plain = text.decode("utf-8", "replace")
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in plain)
    return low.encode()


def slices(texts: list[bytes], limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes."""
    limit = limit or BLOCK_BYTES
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over [offsets[i], offsets[i+1]); empty ranges give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
